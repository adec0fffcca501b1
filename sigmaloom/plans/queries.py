"""The registered queries on the driver's tables, and the SQL that each must equal.

Sites are customer or order keys modulo 3, subjects are customers. Queries called sufficient_* are statistics that a site keeps
to itself; the release queries use a fixed public test key, so their noise protects nothing here.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean, keyed, models, paths
from ..operators import joins, linear, metrics, pooling, privacy, statistics, trees, units, validation
from ..sources import readers, store
from . import contract as contracts
from . import prepare as prepared
from . import tree_sql

#: A public test key: whoever has it can undo the keyed partitions and the noise of these queries.
TEST_KEY = bytes(range(32))
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pads() -> tuple[str, str]:
    return keyed._pads(TEST_KEY)


def _hmac_sql(kind: str, unit: str, domain: str) -> str:
    inner, outer = _pads()
    message = f"encode('{domain}' || chr(0) || '{kind}' || chr(0) || printf('%08X', octet_length(encode({unit}))) || {unit})"
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || {message})))"


# --- association ---------------------------------------------------------------------------------------------------

_CODES = "CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 2 END AS e, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS o"
_EVER = "CASE WHEN bool_or({0} = 1) THEN 1 WHEN bool_or({0} = 0) THEN 0 ELSE 2 END AS {0}"
_SUBJECTS = f"c AS (SELECT o_custkey % 3 AS site, o_custkey AS unit, {_CODES} FROM orders), u AS (SELECT site, unit, {_EVER.format('e')}, {_EVER.format('o')} FROM c GROUP BY site, unit)"
_CELLS = f"{_SUBJECTS}, k AS (SELECT site, e * 3 + o AS coord, count(*) AS value FROM u GROUP BY ALL), a AS (SELECT s.site, r.coord, coalesce(value, 0) AS value FROM (SELECT DISTINCT site FROM u) s CROSS JOIN (SELECT unnest(range(9)) AS coord) r LEFT JOIN k USING (site, coord))"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    codes = {"e": clean.association_code(F.col("o_orderpriority"), ("5-LOW", "1-URGENT")), "o": clean.association_code(F.col("o_orderstatus"), ("O", "F"))}
    return o.select((F.col("o_custkey") % 3).cast("int").alias("site"), clean.unit_id(F.col("o_custkey")).alias("unit"), *[c.alias(n) for n, c in codes.items()])


def _subject_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.association(units.ever_positive(_orders(spark, sf_dir), ["site", "unit"], ["e", "o"]), ["site"], "e", "o")


@_query(f"WITH {_CELLS} SELECT site::INT AS site, coord::INT AS coord, value::BIGINT AS value FROM a")
def sufficient_association_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subject_cells(spark, sf_dir)


@_query(f"WITH c AS (SELECT {_CODES} FROM orders), k AS (SELECT e * 3 + o AS coord, count(*) AS value FROM c GROUP BY ALL) SELECT coord::INT AS coord, coalesce(value, 0)::BIGINT AS value FROM (SELECT unnest(range(9)) AS coord) LEFT JOIN k USING (coord)")
def sufficient_association_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.association(_orders(spark, sf_dir), [], "e", "o")


@_query(f"WITH {_CELLS} SELECT coord::INT AS coord, sum(value)::DOUBLE AS value, true AS available FROM a GROUP BY coord")
def pooled_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pooling.pooled(_subject_cells(spark, sf_dir), "site", 3, 9)


@_query(
    f"""WITH {_CELLS}, v AS (SELECT count(DISTINCT site) = 3 AND count(*) = 27 AS available FROM a WHERE site < 2)
    SELECT coord::INT AS coord, CASE WHEN available THEN sum(value) END::DOUBLE AS value, available FROM a CROSS JOIN v GROUP BY coord, available"""
)
def pooled_association_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pooling.pooled(_subject_cells(spark, sf_dir).where("site < 2"), "site", 3, 9)


@_query(
    f"""WITH {_CELLS}, p AS (SELECT coord, sum(value)::DOUBLE AS v FROM a GROUP BY coord),
    x AS (SELECT max(v) FILTER (coord = 4) AS a, max(v) FILTER (coord = 3) AS b, max(v) FILTER (coord = 1) AS c, max(v) FILTER (coord = 0) AS d FROM p),
    r AS (SELECT *, CASE WHEN a + b > 0 THEN a / (a + b) END AS pe, CASE WHEN c + d > 0 THEN c / (c + d) END AS pu FROM x)
    SELECT round(CASE WHEN least(a, b, c, d) > 0 THEN exp(ln(a) + ln(d) - ln(b) - ln(c)) END, 8) AS odds_ratio, round(pu, 8) AS prevalence_unexposed, round(pe, 8) AS prevalence_exposed,
    round(pe - pu, 8) AS prevalence_difference, round(CASE WHEN pu > 0 THEN pe / pu END, 8) AS prevalence_ratio FROM r"""
)
def association_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.association_measures(pooled_association(spark, sf_dir), [])
    return m.select(*[F.round(c, 8).alias(c) for c in m.columns])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return association_measures(spark, sf_dir)


@_query()
def released_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A noised vector of each site, pooled, with the measures; all vectors have nine cells."""
    cells = [r.asDict() for r in _subject_cells(spark, sf_dir).collect()]
    sigma = privacy.gaussian_sigma(1.0, 1e-6, privacy.sensitivity("association"))
    rows = []
    for site in sorted({r["site"] for r in cells}):
        vector = [r["value"] for r in sorted((r for r in cells if r["site"] == site), key=lambda r: r["coord"])]
        rows += [(site, k, float(v)) for k, v in enumerate(privacy.release(vector, sigma, TEST_KEY, "association", {"site": site}))]
    noised = spark.createDataFrame(rows, "site int, coord int, value double")
    return metrics.association_measures(pooling.pooled(noised, "site", 3, 9), [])


@_query()
def released_part_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part the number of its lines, as each order counts once for one part of its own, with exact discrete Gaussian noise; parts
    are public, and parts without lines have noise, too. An order that is replaced moves two counts by 1."""
    lines = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("coord")).groupBy("coord").agg(F.count(F.lit(1)).alias("value"))
    cells = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("coord")).join(lines, "coord", "left")
    sigma = math.ceil(privacy.gaussian_sigma(1.0, 1e-6, math.sqrt(2)))
    return privacy.release_cells(cells, sigma, TEST_KEY, "part orders", {"cells": "parts"})


@_query("WITH s AS (SELECT 1 + count(*) / 100.0 AS sigma FROM customer GROUP BY c_nationkey) SELECT round(sqrt(sum(sigma * sigma)), 8)::DOUBLE AS noise_sd_pooled FROM s")
def pooled_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site for each nation, with a noise that depends on its customers."""
    sigmas = _t(spark, sf_dir, "customer").groupBy("c_nationkey").agg((1 + F.count(F.lit(1)) / 100.0).alias("sigma"))
    return pooling.pooled_noise(sigmas).select(F.round("noise_sd_pooled", 8).alias("noise_sd_pooled"))



# --- cleaning --------------------------------------------------------------------------------------------------------

_DIRTY = "CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN 'x' WHEN l_linenumber = 3 THEN 'NaN' WHEN l_linenumber = 4 THEN 'Infinity' WHEN l_linenumber = 5 THEN '-1e300' ELSE l_quantity::VARCHAR END"
_LI = "l_orderkey, l_linenumber"


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.expr("CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN 'x' WHEN 3 THEN 'NaN' WHEN 4 THEN 'Infinity' WHEN 5 THEN '-1e300' ELSE cast(l_quantity AS STRING) END")
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", d.alias("d"))


@_query(
    f"""WITH d AS (SELECT {_LI}, TRY_CAST({_DIRTY} AS DOUBLE) AS x FROM lineitem), f AS (SELECT *, x IS NOT NULL AND isfinite(x) AS ok FROM d)
    SELECT {_LI}, CASE WHEN ok THEN greatest(-1e6, least(1e6, x)) ELSE 25.5 END AS feature, CASE WHEN x IS NULL OR isnan(x) THEN 0 ELSE greatest(-1e6, least(1e6, x)) END::FLOAT::DOUBLE AS model_feature,
    round((CASE WHEN ok THEN greatest(1, least(50, x)) ELSE 25.5 END - 25.5) / 24.5, 9) AS scaled, CASE WHEN NOT isnan(x) THEN greatest(1, least(50, x)) END::DOUBLE AS tree_feature,
    CASE WHEN ok THEN greatest(1, least(50, x)) ELSE 25.5 END::DOUBLE AS regression_target, CASE WHEN ok AND x >= 0.5 THEN 1 ELSE 0 END::INT AS binary_tree_target FROM f"""
)
def cleaned_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("d")
    return _dirty(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", clean.feature(d, 1, 50).alias("feature"), clean.model_feature(d).cast("double").alias("model_feature"), F.round(clean.scaled(d, 1, 50), 9).alias("scaled"),
        clean.tree_feature(d, 1, 50).alias("tree_feature"), clean.regression_target(d, 1, 50).alias("regression_target"), clean.binary_tree_target(d).alias("binary_tree_target"),
    )


@_query(
    """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 WHEN 'FURNITURE' THEN 2 ELSE 0 END::INT AS level,
    CASE WHEN c_nationkey BETWEEN 0 AND 4 THEN c_nationkey ELSE 0 END::INT AS code, [(CASE WHEN c_nationkey BETWEEN 0 AND 4 THEN c_nationkey ELSE 0 END > 0)::INT, (CASE WHEN c_nationkey BETWEEN 0 AND 4 THEN c_nationkey ELSE 0 END > 1)::INT,
    (CASE WHEN c_nationkey BETWEEN 0 AND 4 THEN c_nationkey ELSE 0 END > 2)::INT, (CASE WHEN c_nationkey BETWEEN 0 AND 4 THEN c_nationkey ELSE 0 END > 3)::INT] AS ordinal FROM customer"""
)
def cleaned_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = clean.integer_code(F.col("c_nationkey"), 5)
    return _t(spark, sf_dir, "customer").select("c_custkey", clean.level_code(F.col("c_mktsegment"), ("BUILDING", "MACHINERY", "FURNITURE")).alias("level"), code.alias("code"), clean.ordinal_targets(code, 5).alias("ordinal"))


@_query(
    r"""WITH d AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN ' NaN ' WHEN 2 THEN chr(9) || o_custkey || ' ' WHEN 3 THEN '<NA>' WHEN 4 THEN '' ELSE o_custkey::VARCHAR END AS raw FROM orders),
    t AS (SELECT o_orderkey, trim(raw, ' ' || chr(9) || chr(13) || chr(10)) AS s FROM d)
    SELECT o_orderkey, CASE WHEN s IS NULL OR s = '' OR lower(s) IN ('na', 'nan', 'null', '<na>', 'nat') THEN '__missing_unit__' ELSE s END AS unit FROM t"""
)
def canonical_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr(r"CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN ' NaN ' WHEN 2 THEN concat(char(9), o_custkey, ' ') WHEN 3 THEN '<NA>' WHEN 4 THEN '' ELSE cast(o_custkey AS STRING) END")
    return _t(spark, sf_dir, "orders").select("o_orderkey", clean.unit_id(raw).alias("unit"))


@_query("SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_units FROM orders")
def unit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.count_units(_orders(spark, sf_dir), "unit")


_CUTS = (5.0, 10.0, 20.0, 40.0)


@_query("SELECT l_orderkey, l_linenumber, len(list_filter([5.0, 10.0, 20.0, 40.0], lambda c: c < l_quantity))::INT AS bin, least(floor(least(greatest(round(l_discount * 10, 9), 0), 1) * 16), 15)::INT AS score_bin FROM lineitem")
def binned_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", clean.bin_of(F.col("l_quantity"), _CUTS).alias("bin"), clean.score_bin(F.round(F.col("l_discount") * 10, 9), 16).alias("score_bin"))


@_query(
    r"""WITH u AS (SELECT page_id, regexp_extract(url, '://(.*)$', 1) AS p FROM pages)
    SELECT page_id, CASE WHEN p IS NULL OR p = '' OR regexp_matches(p, '[\x00-\x1f\x7f\\]') OR starts_with(p, '/') OR regexp_matches(p, '^[A-Za-z]:') OR len(list_filter(string_split(p, '/'), lambda x: x IN ('', '.', '..'))) > 0 THEN '__invalid_path__' ELSE p END AS path,
    regexp_replace(list_extract(string_split(p, '/'), -1), '(?i)(\.nii\.gz|\.dicom|\.tiff|\.jpeg|\.nrrd|\.nii|\.dcm|\.png|\.jpg|\.tif|\.mha)$', '') AS stem FROM u"""
)
def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.regexp_extract("url", "://(.*)$", 1)
    return _t(spark, sf_dir, "pages").select("page_id", paths.safe_relative(p).alias("path"), paths.stem(p).alias("stem"))


@_query("SELECT event_id, event_type || '/' || event_id || '.png' AS path, 'bucket' AS bucket, 'site/' || event_type || '/' || event_id || '.png' AS key FROM events")
def object_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").withColumn("uri", F.concat(F.lit("s3://bucket/site/"), "event_type", F.lit("/"), F.col("event_id").cast("string"), F.lit(".png")))
    return e.select("event_id", paths.below_prefix(F.col("uri"), "s3://bucket/site").alias("path"), paths.bucket(F.col("uri")).alias("bucket"), paths.object_key(F.col("uri")).alias("key"))


@_query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'a' || event_id WHEN event_id % 3 = 1 THEN 'u' || event_id END AS path FROM events")
def primary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = "concat('[{\"role\":\"mask\",\"path\":\"m\"},{\"role\":\"Image\",\"path\":\"a', event_id, '\"}]')", "concat('[{\"role\":\"other\",\"path\":\"\",\"uri\":\"u', event_id, '\"}]')"
    return _t(spark, sf_dir, "events").select("event_id", paths.primary_file(F.expr(f"CASE event_id % 3 WHEN 0 THEN {one} WHEN 1 THEN {two} ELSE '[]' END")).alias("path"))


# --- keyed partitions -------------------------------------------------------------------------------------------------


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select("o_orderkey", clean.unit_id(F.col("o_custkey")).alias("unit"))


@_query(f"SELECT o_orderkey, {_hmac_sql('subject', 'o_custkey::VARCHAR', 'holdout/v1')} < '{keyed.threshold_hex(200_000, 1_000_000)}' AS test_20, {_hmac_sql('subject', 'o_custkey::VARCHAR', 'holdout/v1')} < '{keyed.threshold_hex(300_000, 1_000_000)}' AS test_30 FROM orders")
def holdout_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _units(spark, sf_dir)
    return u.select("o_orderkey", *[keyed.holdout(TEST_KEY, F.col("unit"), n * 10_000).alias(f"test_{n}") for n in (20, 30)])


def _fold_sql(k: int, unit: str = "o_custkey") -> str:
    h = _hmac_sql("subject", f"{unit}::VARCHAR", "folds/v1")
    return "1 + " + " + ".join(f"({h} >= '{-(-i * (1 << 256) // k):064x}')::INT" for i in range(1, k))


@_query(f"SELECT o_orderkey, ({_fold_sql(5)})::INT AS fold_5, ({_fold_sql(10)})::INT AS fold_10 FROM orders")
def cross_validation_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _units(spark, sf_dir)
    return u.select("o_orderkey", *[keyed.fold(TEST_KEY, F.col("unit"), k).alias(f"fold_{k}") for k in (5, 10)])


@_query(f"SELECT o_orderkey, (('0x' || substr({_hmac_sql('subject', 'o_custkey::VARCHAR', 'block/v1')}, 1, 15))::BIGINT % 8)::INT AS block FROM orders")
def subject_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units(spark, sf_dir).select("o_orderkey", keyed.block(TEST_KEY, F.col("unit"), 8).alias("block"))


_SIDES = f"s AS (SELECT o_orderkey, {_hmac_sql('subject', 'o_custkey::VARCHAR', 'holdout/v1')} AS h FROM orders), t AS (SELECT o_orderkey, h < '{keyed.threshold_hex(200_000, 1_000_000)}' AS test_20, h < '{keyed.threshold_hex(300_000, 1_000_000)}' AS test_30 FROM s)"


@_query(
    f"""WITH {_SIDES}, b AS (SELECT o_orderkey FROM t WHERE test_20 INTERSECT SELECT o_orderkey FROM t WHERE NOT test_20)
    SELECT count(*) AS rows, count(*) FILTER (test_20 OR NOT test_20) AS in_train_or_test, (SELECT count(*) FROM b) AS in_both, count(*) FILTER (test_20 AND NOT test_30) AS not_nested FROM t"""
)
def holdout_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = holdout_sides(spark, sf_dir)
    train, test = s.where("not test_20").select("o_orderkey"), s.where("test_20").select("o_orderkey")
    both = train.intersect(test).agg(F.count(F.lit(1)).alias("in_both"))
    return s.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.expr("test_20 or not test_20")).alias("in_train_or_test"), F.count_if(F.expr("test_20 and not test_30")).alias("not_nested")).crossJoin(F.broadcast(both))


# --- joins ------------------------------------------------------------------------------------------------------------


@_query("WITH l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id HAVING count(*) = 1) SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN l USING (doc_id)")
def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.label_join(_t(spark, sf_dir, "documents").select("doc_id"), _t(spark, sf_dir, "labels"), "doc_id", ["quality", "toxic"])


@_query("WITH e AS (SELECT user_id, arg_min(event_type, event_id) AS first_type FROM events GROUP BY user_id) SELECT c_custkey, first_type FROM customer LEFT JOIN e ON c_custkey = user_id")
def first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.first_match(_t(spark, sf_dir, "customer").select("c_custkey"), _t(spark, sf_dir, "events"), F.col("c_custkey"), "user_id", "event_type", "event_id", "first_type")


# --- sufficient statistics and metrics ------------------------------------------------------------------------------------

_SCORE = "least(greatest(round(0.1 + 0.016 * l_quantity, 9), 0), 1)"
_HIST = f"h AS (SELECT (l_returnflag = 'R')::INT * 16 + least(floor({_SCORE} * 16), 15) AS coord, count(*) AS n FROM lineitem GROUP BY 1), d AS (SELECT r.coord, coalesce(n, 0) AS value FROM (SELECT unnest(range(32)) AS coord) r LEFT JOIN h USING (coord))"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", (F.col("l_returnflag") == "R").cast("int").alias("y"), F.round(0.1 + 0.016 * F.col("l_quantity"), 9).alias("p"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("disc"))


@_query(f"WITH {_HIST} SELECT coord::INT AS coord, value::BIGINT AS value FROM d")
def sufficient_score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.score_histogram(_scored(spark, sf_dir), [], F.col("y"), F.col("p"), 16)


@_query(
    f"""WITH {_HIST}, b AS (SELECT coord % 16 AS bin, sum(value) FILTER (coord >= 16)::DOUBLE AS pos, sum(value) FILTER (coord < 16)::DOUBLE AS neg FROM d GROUP BY 1),
    c AS (SELECT bin, sum(pos) OVER w / sum(pos) OVER () AS tpr, sum(neg) OVER w / sum(neg) OVER () AS fpr FROM b WINDOW w AS (ORDER BY bin DESC)),
    s AS (SELECT (fpr - lag(fpr, 1, 0) OVER v) * (tpr + lag(tpr, 1, 0) OVER v) / 2 AS area FROM c WINDOW v AS (ORDER BY bin DESC)) SELECT round(sum(area), 8) AS roc_auc FROM s"""
)
def score_roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_auc(sufficient_score_histogram(spark, sf_dir), [], 16).select(F.round("roc_auc", 8).alias("roc_auc"))


@_query(
    f"""WITH {_HIST}, b AS (SELECT coord % 16 AS bin, sum(value) FILTER (coord >= 16)::DOUBLE AS pos, sum(value) FILTER (coord < 16)::DOUBLE AS neg FROM d GROUP BY 1),
    s AS (SELECT sum(pos + neg) AS n, sum(pos) FILTER (bin >= 8) AS tp, sum(neg) FILTER (bin >= 8) AS fp, sum(pos) FILTER (bin < 8) AS fn, sum(neg) FILTER (bin < 8) AS tn, sum(pos * (1 - (bin + 0.5) / 16) ** 2 + neg * ((bin + 0.5) / 16) ** 2) AS br,
      sum((pos + neg) * abs(CASE WHEN pos + neg > 0 THEN pos / (pos + neg) ELSE 0 END - (bin + 0.5) / 16)) AS ece FROM b)
    SELECT n::DOUBLE AS n, round((tp + tn) / n, 8) AS accuracy, round(tp / (tp + fn), 8) AS sensitivity, round(tn / (tn + fp), 8) AS specificity, round(tp / (tp + fp), 8) AS precision, round(br / n, 8) AS brier, round(ece / n, 8) AS expected_calibration_error FROM s"""
)
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector = [r["value"] for r in sufficient_score_histogram(spark, sf_dir).orderBy("coord").collect()]
    m = metrics.guarded(metrics.binary(vector, 16))
    names = ("n", "accuracy", "sensitivity", "specificity", "precision", "brier", "expected_calibration_error")
    return spark.createDataFrame([tuple(round(m[n], 8) for n in names)], ", ".join(f"{n} double" for n in names))


@_query(
    """WITH s AS (SELECT label % 3 AS y, list_transform(embedding[1:3], lambda v: least(greatest(v::DOUBLE, 0), 1)) AS p FROM embeddings), t AS (SELECT y, list_sum(p) AS s, p FROM s),
    n AS (SELECT y, CASE WHEN s > 0 THEN list_transform(p, lambda v: v / s) ELSE [1/3.0, 1/3.0, 1/3.0]::DOUBLE[] END AS p FROM t), k AS (SELECT y * 3 + list_position(p, list_max(p)) - 1 AS coord FROM n
    UNION ALL SELECT 9 + (c * 2 + (y = c)::INT) * 4 + least(floor(p[c + 1] * 4), 3) FROM n, (SELECT unnest(range(3)) AS c)), g AS (SELECT coord, count(*) AS v FROM k GROUP BY coord)
    SELECT coord::INT AS coord, coalesce(v, 0)::BIGINT AS value FROM (SELECT unnest(range(33)) AS coord) LEFT JOIN g USING (coord)"""
)
def sufficient_multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings").select((F.col("label") % 3).alias("y"), F.transform(F.slice("embedding", 1, 3), lambda v: v.cast("double")).alias("p"))
    return statistics.multiclass(e, [], F.col("y"), F.col("p"), 3, 4)


@_query(
    """WITH l AS (SELECT [quality, toxic] AS y, [least((doc_id % 17) / 16.0, 1), least((doc_id % 5) / 4.0, 1)]::DOUBLE[] AS p FROM labels), k AS (SELECT (i * 2 + y[i + 1]) * 8 + least(floor(p[i + 1] * 8), 7) AS coord FROM l, (SELECT unnest(range(2)) AS i)),
    g AS (SELECT coord, count(*) AS v FROM k GROUP BY coord) SELECT coord::INT AS coord, coalesce(v, 0)::BIGINT AS value FROM (SELECT unnest(range(32)) AS coord) LEFT JOIN g USING (coord)"""
)
def sufficient_multilabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    rows = _t(spark, sf_dir, "labels").select(F.array("quality", "toxic").alias("y"), F.array((d % 17) / 16.0, (d % 5) / 4.0).alias("p"))
    return statistics.multilabel(rows, [], F.col("y"), F.col("p"), 2, 8)


_REG = "SELECT (least(greatest(l_extendedprice, 900), 105000) - 900) / 104100 AS y, (least(greatest(l_quantity * 1500, 900), 105000) - 900) / 104100 AS p FROM lineitem"


@_query(
    f"""WITH r AS ({_REG}), s AS (SELECT [count(*)::DOUBLE, sum(abs(y - p)), sum((y - p) ** 2), sum(y), sum(y * y)] AS v FROM r) SELECT i::INT AS coord, round(v[i + 1], 4) AS value FROM s, (SELECT unnest(range(5)) AS i)"""
)
def sufficient_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = statistics.regression_sums(_t(spark, sf_dir, "lineitem"), [], F.col("l_extendedprice"), F.col("l_quantity") * 1500, 900, 105_000)
    return r.select("coord", F.round("value", 4).alias("value"))


@_query(
    f"""WITH r AS ({_REG}), s AS (SELECT count(*)::DOUBLE AS n, sum(abs(y - p)) AS a, sum((y - p) ** 2) AS q, sum(y) AS s1, sum(y * y) AS s2 FROM r)
    SELECT n, round(a / n * 104100, 3) AS mae, round(sqrt(q / n) * 104100, 3) AS rmse, round(1 - q / (s2 - s1 * s1 / n), 6) AS r_squared FROM s"""
)
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = statistics.regression_sums(_t(spark, sf_dir, "lineitem"), [], F.col("l_extendedprice"), F.col("l_quantity") * 1500, 900, 105_000).orderBy("coord").collect()
    m = metrics.regression([x["value"] for x in r], 900, 105_000)
    return spark.createDataFrame([tuple(round(float(m[k]), d) for k, d in (("n", 0), ("mae", 3), ("rmse", 3), ("r_squared", 6)))], "n double, mae double, rmse double, r_squared double")


@_query(
    """WITH r AS (SELECT least(greatest(l_linenumber, 0), 7)::DOUBLE AS y, least(greatest(l_quantity / 7, 1e-8), 7) AS p FROM lineitem), d AS (SELECT *, greatest(0, 2 * (CASE WHEN y > 0 THEN y * ln(y / p) - (y - p) ELSE p END)) AS v FROM r)
    SELECT round(sum(least(v / greatest(14, 2 * (7 * ln(7 / 1e-8) - 7)), 1)), 4) AS deviance, round(sum(abs(y - p) / 7), 4) AS error FROM d"""
)
def sufficient_count_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = statistics.regression_sums(_t(spark, sf_dir, "lineitem"), [], F.col("l_linenumber"), F.col("l_quantity") / 7, 0, 7, count_task=True)
    pick = lambda k: F.round(F.max(F.when(F.col("coord") == k, F.col("value"))), 4)
    return r.agg(pick(5).alias("deviance"), pick(1).alias("error"))


@_query(
    """WITH k AS (SELECT o_custkey AS unit, (o_orderstatus = 'F')::INT * 8 + least(floor(round((o_orderkey % 97) / 96.0, 9) * 8), 7) AS coord FROM orders), c AS (SELECT unit, coord, count(*) AS n FROM k GROUP BY ALL),
    t AS (SELECT unit, coord, n, sum(n) OVER (PARTITION BY unit) AS rows, sum(n) OVER (PARTITION BY unit ORDER BY coord ROWS UNBOUNDED PRECEDING) - n AS before FROM c),
    p AS (SELECT coord, ((4503599627370496 // rows) * n + least(greatest(4503599627370496 % rows - before, 0), n))::HUGEINT AS parts FROM t), g AS (SELECT coord, sum(parts)::DOUBLE / 4503599627370496.0 AS v FROM p GROUP BY coord)
    SELECT coord::INT AS coord, round(coalesce(v, 0), 9) AS value FROM (SELECT unnest(range(16)) AS coord) LEFT JOIN g USING (coord)"""
)
def sufficient_unit_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.round((F.col("o_orderkey") % 97) / 96.0, 9)
    coord = (F.col("o_orderstatus") == "F").cast("int") * 8 + clean.score_bin(score, 8)
    return statistics.unit_mass(_t(spark, sf_dir, "orders"), [], "o_custkey", coord, 16).select("coord", F.round("value", 9).alias("value"))


@_query("SELECT o_custkey AS unit, avg(round(o_totalprice * 100)::BIGINT) AS mean_cents FROM orders GROUP BY 1")
def pooled_subject_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("unit"), F.round(F.col("o_totalprice") * 100).cast("long").alias("mean_cents"))
    return units.pooled_means(o, "unit", ["mean_cents"])


@_query("WITH c AS (SELECT o_custkey AS unit, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) SELECT unit, first(o_orderstatus ORDER BY n DESC, o_orderstatus) AS o_orderstatus FROM c GROUP BY unit")
def pooled_subject_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.pooled_mode(_t(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "unit"), "unit", "o_orderstatus")


@_query("SELECT o_custkey AS unit, (2 * sum((o_orderstatus = 'F')::INT) > count(*))::INT AS y, least(greatest(avg(round(o_totalprice * 100)::BIGINT), 200000), 40000000)::DOUBLE AS cents, (2 * sum((o_orderpriority = '1-URGENT')::INT) >= count(*))::INT AS urgent FROM orders GROUP BY 1")
def pooled_tree_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("unit"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("urgent"))
    t = units.pooled_tree_units(o, "unit", {"cents": (200_000.0, 40_000_000.0)}, "y", "binary")
    return t.join(units.pooled_multilabel(o, "unit", ["urgent"]), "unit").select("unit", "y", "cents", "urgent")


@_query("SELECT l_suppkey, count(*) AS n, CASE WHEN count(*) <= 3 THEN 0 ELSE (2 ** round_even(log2(count(*)), 0))::BIGINT END AS bucket FROM lineitem GROUP BY 1")
def bucketed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", statistics.bucketed_count(F.col("n")))


@_query("WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal FROM orders) SELECT * FROM r")
def row_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.numbered(_t(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"]).select("o_orderkey", F.col("ordinal").cast("long").alias("ordinal"))


@_query(f"""WITH f AS (SELECT o_orderstatus, ({_fold_sql(5)}) AS fold FROM orders), n AS (SELECT count(DISTINCT fold) = 5 AS available FROM f),
    g AS (SELECT (o_orderstatus = 'O')::INT AS coord, count(*) AS v FROM f GROUP BY 1) SELECT coord, CASE WHEN available THEN v END::DOUBLE AS value, available FROM g CROSS JOIN n""")  # fmt: skip
def accumulated_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of open orders, and of others, over five folds of subjects."""
    o = _t(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "O").cast("int").alias("coord"), keyed.fold(TEST_KEY, clean.unit_id(F.col("o_custkey")), 5).alias("fold"))
    vectors = o.groupBy("fold", "coord").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return pooling.accumulated_folds(vectors, 5)


@_query(f"SELECT o_orderkey, (ntile(7) OVER (ORDER BY {_hmac_sql('row', 'o_orderkey::VARCHAR', 'row-blocks/v1')}, o_orderkey) - 1)::INT AS block FROM orders")
def row_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.row_blocks(_t(spark, sf_dir, "orders").select("o_orderkey"), TEST_KEY, ["o_orderkey"], 7).select("o_orderkey", "block")


@_query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment HAVING count(*) >= 30")
def small_cells_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.small_cells_hidden(_t(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")), "n", 30)


# --- tree and gradient statistics --------------------------------------------------------------------------------------

_SCHEMA = trees.TreeSchema(("l_quantity", "l_discount", "l_tax"), ((10.0, 25.0, 40.0), (0.025, 0.055, 0.085), (0.025, 0.055)))


def _tree_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", *_SCHEMA.features, (F.col("l_quantity") * (1 - 4 * F.col("l_discount")) > 20).cast("int").alias("y"))


_B = "len(list_filter([10.0, 25.0, 40.0], lambda c: c < l_quantity)) AS b0, len(list_filter([0.025, 0.055, 0.085], lambda c: c < l_discount)) AS b1, len(list_filter([0.025, 0.055], lambda c: c < l_tax)) AS b2, (l_quantity * (1 - 4 * l_discount) > 20)::INT AS y"


@_query(
    f"""WITH r AS (SELECT {_B} FROM lineitem), f AS (SELECT 0 AS feature, b0 AS bin, y FROM r UNION ALL SELECT 1, b1, y FROM r UNION ALL SELECT 2, b2, y FROM r)
    SELECT 0::INT AS slot, feature::INT AS feature, bin::INT AS bin, sum(CASE WHEN y = 1 THEN -524288 ELSE 524288 END)::BIGINT AS g, (count(*) * 262144)::BIGINT AS h, count(*) AS n FROM f GROUP BY ALL"""
)
def sufficient_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = statistics.binned(_tree_rows(spark, sf_dir), dict(zip(_SCHEMA.features, _SCHEMA.cuts, strict=True)))
    g, h = statistics.gradient_columns(F.lit(0.0), F.col("y"), "binary", 1.0, 1.0)
    return statistics.gradient_histogram(rows, F.lit(0), {k: F.col(f"b_{f}") for k, f in enumerate(_SCHEMA.features)}, _SCHEMA.bins - 1, g, h)


def _leaf_sql(tree: dict, depth: int) -> str:
    def walk(node: int, level: int) -> str:
        if level == depth:
            return str(node - ((1 << depth) - 1))
        return f"(CASE WHEN b{tree['features'][node]} <= {tree['cuts'][node]} THEN {walk(2 * node + 1, level + 1)} ELSE {walk(2 * node + 2, level + 1)} END)"

    return walk(0, 0)


_TOPOLOGY = trees.random_topology(_SCHEMA, 4, 3)


@_query(
    f"""WITH r AS (SELECT {_B} FROM lineitem), l AS ({' UNION ALL '.join(f'SELECT {t} AS t, {_leaf_sql(tree, 3)} AS leaf, y FROM r' for t, tree in enumerate(_TOPOLOGY))}),
    c AS (SELECT t, leaf * 2 + y AS coord, count(*) AS n FROM l GROUP BY ALL) SELECT t::INT AS t, coord::INT AS coord, coalesce(n, 0)::BIGINT AS value FROM (SELECT unnest(range(4)) AS t) CROSS JOIN (SELECT unnest(range(16)) AS coord) LEFT JOIN c USING (t, coord)"""
)
def sufficient_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.array(*[clean.bin_of(F.col(f), c) for f, c in zip(_SCHEMA.features, _SCHEMA.cuts, strict=True)])
    leaves = F.posexplode(F.array(*[trees.heap_leaf(t, 3) for t in _TOPOLOGY])).alias("t", "leaf")
    rows = _tree_rows(spark, sf_dir).select(b.alias("b"), "y").select("y", leaves)
    return statistics.leaf_statistics(rows, ["t"], F.col("leaf"), F.col("y"), 8, "binary")


def _trained(engine: str, spark: SparkSession, sf_dir: str, **parameters: float) -> DataFrame:
    rows = _tree_rows(spark, sf_dir)
    model = trees.sanitised(trees.train(engine, rows, _SCHEMA, "y", key=TEST_KEY, **parameters), _SCHEMA)
    scored = trees.predict(rows, [model], _SCHEMA, ["l_orderkey", "l_linenumber", "y"])
    return scored.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(((F.col("prediction") >= 0.5) == (F.col("y") == 1)).cast("double")), 6).alias("accuracy"))


_FOREST = trees.random_topology(_SCHEMA, 32, 4)


@_query(
    f"""WITH r AS (SELECT {_B} FROM lineitem), c AS (SELECT b0, b1, b2, count(*) AS n, sum(y) AS pos FROM r GROUP BY ALL),
    l AS ({' UNION ALL '.join(f'SELECT {t} AS t, {_leaf_sql(tree, 4)} AS leaf, b0, b1, b2, n, pos FROM c' for t, tree in enumerate(_FOREST))}),
    v AS (SELECT t, leaf, (sum(pos) + 1)::DOUBLE / (sum(n) + 2)::DOUBLE AS value FROM l GROUP BY ALL),
    p AS (SELECT b0, b1, b2, any_value(n) AS n, any_value(pos) AS pos, list_reduce(list(value ORDER BY t), lambda a, b: a + b) / 32 AS p FROM l JOIN v USING (t, leaf) GROUP BY b0, b1, b2)
    SELECT sum(n)::BIGINT AS n, round(sum(CASE WHEN p >= 0.5 THEN pos ELSE n - pos END)::DOUBLE / sum(n)::DOUBLE, 6) AS accuracy FROM p"""
)
def extra_trees_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trained("extra_trees", spark, sf_dir, trees=32, depth=4)


@_query()
def private_extra_trees_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trained("extra_trees", spark, sf_dir, trees=32, depth=4, epsilon=3.0, delta=1e-6, secret=TEST_KEY)


@_query()
def private_depthwise_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trained("xgboost", spark, sf_dir, trees=3, depth=3, rate=0.5, epsilon=3.0, delta=1e-6, secret=TEST_KEY)


@_query(tree_sql.random_forest(_SCHEMA, f"SELECT {_B} FROM lineitem", 8, 4, 2, lambda text: _hmac_sql('record', text, 'tree/v1')))
def random_forest_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trained("random_forest", spark, sf_dir, trees=8, depth=4, max_features=2)


def _folds(engine: str, spark: SparkSession, sf_dir: str, folds: int, **parameters: float) -> DataFrame:
    """Rows of an order are in one fold; each is scored by the model that has not seen its order."""
    rows = store.staged(_tree_rows(spark, sf_dir).withColumn("fold", keyed.fold(TEST_KEY, clean.unit_id(F.col("l_orderkey")), folds)), "folds")  # one hash a row
    models = [trees.sanitised(m, _SCHEMA) for m in validation.train_folds(engine, rows, _SCHEMA, "y", "fold", folds, TEST_KEY, **parameters)]
    scored = validation.out_of_fold(rows, models, _SCHEMA, "fold", ["fold", "y"])
    right = ((F.col("prediction") >= 0.5) == (F.col("y") == 1)).cast("double")
    return scored.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(right), 6).alias("accuracy"))


_FOLD_ROWS = f"SELECT {_B}, ({_fold_sql(4, 'l_orderkey')}) AS fold FROM lineitem"


@_query(
    f"""WITH c AS (SELECT b0, b1, b2, fold, count(*) AS n, sum(y) AS pos FROM ({_FOLD_ROWS}) GROUP BY ALL),
    l AS ({' UNION ALL '.join(f'SELECT {t} AS t, {_leaf_sql(tree, 4)} AS leaf, b0, b1, b2, fold, n, pos FROM c' for t, tree in enumerate(_FOREST))}),
    a AS (SELECT t, leaf, fold, sum(n) AS n, sum(pos) AS pos FROM l GROUP BY ALL),
    v AS (SELECT model, t, leaf, (coalesce(sum(pos) FILTER (fold <> model), 0) + 1)::DOUBLE / (coalesce(sum(n) FILTER (fold <> model), 0) + 2)::DOUBLE AS value FROM a CROSS JOIN (SELECT unnest(range(1, 5)) AS model) GROUP BY ALL),
    p AS (SELECT b0, b1, b2, fold, any_value(n) AS n, any_value(pos) AS pos, list_reduce(list(value ORDER BY l.t), lambda a, b: a + b) / 32 AS p FROM l JOIN v ON v.t = l.t AND v.leaf = l.leaf AND v.model = l.fold GROUP BY b0, b1, b2, fold)
    SELECT fold::INT AS fold, sum(n)::BIGINT AS n, round(sum(CASE WHEN p >= 0.5 THEN pos ELSE n - pos END)::DOUBLE / sum(n)::DOUBLE, 6) AS accuracy FROM p GROUP BY fold"""
)
def cross_validated_extra_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folds("extra_trees", spark, sf_dir, 4, trees=32, depth=4)


@_query(
    " UNION ALL ".join(
        f"SELECT {k}::INT AS fold, n, accuracy FROM ({tree_sql.random_forest(_SCHEMA, _FOLD_ROWS, 4, 3, 2, lambda text: _hmac_sql('record', text, 'tree/v1'), held_out=k)})" for k in range(1, 5)
    )
)
def cross_validated_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folds("random_forest", spark, sf_dir, 4, trees=4, depth=3, max_features=2)


@_query(tree_sql.boosted(_SCHEMA, f"SELECT {_B} FROM lineitem", "leafwise", trees=3, depth=4, rounds=7, rate=0.5))
def leafwise_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trained("lightgbm", spark, sf_dir, trees=3, depth=4, leaves=8, rate=0.5)


@_query(tree_sql.boosted(_SCHEMA, f"SELECT {_B} FROM lineitem", "oblivious", trees=3, depth=3, rounds=3, rate=0.5))
def oblivious_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trained("catboost", spark, sf_dir, trees=3, depth=3, rate=0.5)


@_query(tree_sql.boosted(_SCHEMA, f"SELECT {_B} FROM lineitem", "depthwise", trees=3, depth=3, rounds=3, rate=0.5))
def depthwise_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trained("xgboost", spark, sf_dir, trees=3, depth=3, rate=0.5)


# --- linear models, layers, losses -----------------------------------------------------------------------------------------


def _gradient_sql(steps: int) -> str:
    """Full-batch steps of clipped logistic gradients on two scaled features."""
    ctes = ["x AS (SELECT (least(greatest(l_quantity, 1), 50) - 25.5) / 24.5 AS q, (least(greatest(l_discount, 0), 0.1) - 0.05) / 0.05 AS d, (l_returnflag = 'R')::INT::DOUBLE AS y FROM lineitem)", "w0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c)"]
    for t in range(steps):
        ctes.append(f"r{t} AS (SELECT q, d, 1 / (1 + exp(-(c + q * a + d * b))) - y AS r FROM x CROSS JOIN w{t})")
        ctes.append(f"g{t} AS (SELECT q, d, r, CASE WHEN sqrt((r * q) ** 2 + (r * d) ** 2 + r ** 2) > 1 THEN 1 / sqrt((r * q) ** 2 + (r * d) ** 2 + r ** 2) ELSE 1 END AS s FROM r{t})")
        mean = lambda v: f"0.5 * sum({v} * s) / count(*)"
        ctes.append(f"w{t + 1} AS (SELECT any_value(a) - {mean('r * q')} AS a, any_value(b) - {mean('r * d')} AS b, any_value(c) - {mean('r')} AS c FROM g{t} CROSS JOIN w{t})")
    return f"WITH {', '.join(ctes)} SELECT coord::INT AS coord, round(CASE coord WHEN 0 THEN a WHEN 1 THEN b ELSE c END, 6) AS weight FROM w{steps} CROSS JOIN (SELECT unnest(range(3)) AS coord)"


@_query(_gradient_sql(5))
def logistic_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of a logistic model after full-batch steps."""
    rows = _scored(spark, sf_dir).select(F.col("l_orderkey").cast("string").alias("unit"), "y", clean.scaled(F.col("q"), 1, 50).alias("q"), clean.scaled(F.col("disc"), 0, 0.1).alias("d"))
    w = linear.fit(rows, ["q", "d"], "binary", TEST_KEY, TEST_KEY, rows.count(), steps=5, sample=False)
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in enumerate(w)], "coord int, weight double")


@_query(
    """WITH z AS (SELECT l_orderkey, l_linenumber, (l_quantity - 25) / 10 AS z, (l_returnflag = 'R')::INT::DOUBLE AS y FROM lineitem) SELECT l_orderkey, l_linenumber, round(ln(1 + exp(-abs(z))) + greatest(z, 0) - z * y, 8) AS bce, round((y - z) ** 2, 8) AS mse,
    round(exp(z) - y * z, 8) AS poisson, round(CASE WHEN abs(y - z) <= 1 THEN 0.5 * (y - z) ** 2 ELSE abs(y - z) - 0.5 END, 8) AS huber, round(greatest(0.3 * (y - z), -0.7 * (y - z)), 8) AS quantile, round(greatest(0, 1 - (2 * y - 1) * z), 8) AS hinge FROM z"""
)
def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem")
    l = models.losses((F.col("l_quantity") - 25) / 10, (F.col("l_returnflag") == "R").cast("double"), tau=0.3)
    names = {"bce": "bce_logits", "mse": "mse", "poisson": "poisson_nll", "huber": "huber", "quantile": "quantile", "hinge": "hinge"}
    return li.select("l_orderkey", "l_linenumber", *[F.round(l[v], 8).alias(k) for k, v in names.items()])


@_query(
    """WITH x AS (SELECT vec_id, [embedding[1]::DOUBLE, embedding[2]::DOUBLE] AS v FROM embeddings), h AS (SELECT vec_id, [greatest(v[1] - v[2] + 0.5, 0), greatest(2 * v[1] + v[2], 0)] AS h FROM x), o AS (SELECT vec_id, [h[1] + h[2], h[1] - h[2], -h[1]] AS z FROM h),
    e AS (SELECT vec_id, list_transform(z, lambda a: exp(a - list_max(z))) AS e FROM o) SELECT vec_id, list_transform(e, lambda a: round(a / list_sum(e), 8)) AS p FROM e"""
)
def small_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.transform(F.slice("embedding", 1, 2), lambda v: v.cast("double"))
    z = models.build([{"op": "linear", "weights": [[1, -1], [2, 1]], "bias": [0.5, 0]}, {"op": "relu"}, {"op": "linear", "weights": [[1, 1], [1, -1], [-1, 0]]}], x)
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.transform(models.predictions(z, "cross_entropy"), lambda v: F.round(v, 8)).alias("p"))


# --- sources and plans -----------------------------------------------------------------------------------------------------


@_query("SELECT doc_id, quality FROM labels")
def bounded_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.bounded_projection(spark, f"{sf_dir}/labels.parquet", ["doc_id", "quality"])


def _contract() -> contracts.Contract:
    return contracts.Contract("o_orderstatus", ("o_totalprice",), subject="o_custkey", levels=("O", "F"), bounds={"o_totalprice": (0.0, 500_000.0)}, resampling=contracts.Resampling("holdout", 200_000))


@_query("SELECT o_custkey::VARCHAR AS unit, (o_orderstatus = 'F')::INT AS y, o_totalprice FROM orders")
def prepared_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared.prepare(_t(spark, sf_dir, "orders"), _contract())


@_query(f"WITH s AS (SELECT {_hmac_sql('subject', 'o_custkey::VARCHAR', 'holdout/v1')} < '{keyed.threshold_hex(200_000, 1_000_000)}' AS is_test, o_custkey FROM orders) SELECT is_test, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_units FROM s GROUP BY 1")
def prepared_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = prepared.sides(prepared_orders(spark, sf_dir), _contract(), TEST_KEY)
    return s.groupBy("is_test").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("unit").alias("n_units"))


_PLANS = (("extra_trees", 32, 4, {}), ("random_forest", 8, 4, {"max_features": 2}), ("lightgbm", 3, 4, {"leaves": 8}), ("catboost", 3, 3, {}))


@_query(
    """WITH r AS (SELECT n_regionkey, 0.5 + 0.5 * n_regionkey AS eps, count(*) AS releases FROM nation GROUP BY ALL), l AS (SELECT *, 2 * ln(1 / 1e-6) AS k FROM r)
    SELECT n_regionkey::INT AS region, round(sqrt(2.0) * sqrt(releases) / (2 * eps / (sqrt(k + 2 * eps) + sqrt(k))), 6)::DOUBLE AS sigma FROM l"""
)
def calibrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget for each region, with a release for each of its nations: five rows."""
    regions = _t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n")).collect()
    sigmas = [(int(r["n_regionkey"]), round(privacy.gaussian_sigma(0.5 + 0.5 * r["n_regionkey"], 1e-6, privacy.sensitivity("association"), r["n"]), 6)) for r in regions]
    return spark.createDataFrame(sigmas, "region int, sigma double")


@_query(
    """WITH p(engine, sens, releases) AS (VALUES ('extra_trees', sqrt(2.0 * 32), 1), ('random_forest', sqrt(2.0 * 2), 5), ('lightgbm', sqrt(3.0 * 6), 21), ('catboost', sqrt(3.0 * 6), 9)),
    r AS (SELECT r_regionkey, 1 + 0.5 * r_regionkey AS eps, 2 * ln(1 / 1e-6) AS k FROM region)
    SELECT engine, r_regionkey::INT AS region, releases::INT AS releases, round(sens * sqrt(releases) / (2 * eps / (sqrt(k + 2 * eps) + sqrt(k))), 6)::DOUBLE AS sigma FROM p CROSS JOIN r"""
)
def tree_release_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The noise of the engines' training runs, for a budget of each region."""
    rows = []
    for r in _t(spark, sf_dir, "region").select("r_regionkey").collect():
        for engine, n, depth, more in _PLANS:
            plan = trees.release_plan(engine, _SCHEMA, 1 + 0.5 * r["r_regionkey"], 1e-6, {"trees": n, "depth": depth, **more})
            rows.append((engine, int(r["r_regionkey"]), plan["releases"], round(plan["sigma"], 6)))
    return spark.createDataFrame(rows, "engine string, region int, releases int, sigma double")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import model_queries, source_queries  # noqa: F401  they register theirs

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: _SQL[name] for name in queries() if name in _SQL}
