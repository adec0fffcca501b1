"""Cross-tokenizer alignment against a plain alignment of whole texts."""

import hashlib
import random
from collections import Counter

import pytest

from sigmaloom.llm import alignment
from sigmaloom.llm.bpe import byte_letters
from sigmaloom.llm.queries import tokenizer_file

FILES = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")


def brute(rows):
    """The contract's columns, from whole texts, without chunks."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok = Tokenizer.from_file(FILES[0])
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    letters = byte_letters()
    links, out = {}, {}
    for i, text in rows:
        out[i], links[i] = (0, 0, 0, 0, 0, 0, ""), []
        if not text:
            continue
        a, b = a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)
        ab = [bytes(letters[c] for c in a_tok.id_to_token(x)) for x in a]
        bb = [bytes([int(b_tok.id_to_piece(x)[3:5], 16)]) if b_tok.is_byte(x) else b_tok.id_to_piece(x).replace("▁", " ").encode() for x in b]
        whole = (" " + text).encode()
        if b"".join(ab) != whole or b"".join(bb) != whole:
            continue
        ends = [{sum(map(len, s[: k + 1])): k for k in range(len(s))} for s in (ab, bb)]
        both = sorted(ends[0].keys() & ends[1].keys())
        links[i] = [(a[ends[0][x]], b[ends[1][x]]) for x in both]
        groups, p, q = [], 0, 0
        for x in both:
            groups.append(",".join(map(str, a[p : ends[0][x] + 1])) + "|" + ",".join(map(str, b[q : ends[1][x] + 1])))
            p, q = ends[0][x] + 1, ends[1][x] + 1
        out[i] = (len(a), len(b), len(groups), len(both), 0, 0, hashlib.sha256(";".join(groups).encode()).hexdigest())
    count = Counter(x for each in links.values() for x in each)
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return {i: (*o[:4], sum(count[x] == best[x[1]] for x in links[i]), sum(count[x] for x in links[i]), o[6]) for i, o in out.items()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    parts = ["the", "The", "hello,", "don't", "über", "naïve", "日本語", "\n", "\t", " ", "  ", "x" * 30, "1234", "<|endoftext|>", "<s>", "<0x41>", " ", "\x1c", "\r\n", "🙂", "'ll", "foo_bar", "...", "　", "é", "\x00", "of", "and"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", " ", " ", "", "  ", "\n"]) for _ in range(rng.randrange(1, 40))) for _ in range(250)]
    texts += ["", None, " ", "  ", "a ", " a", "a▁b", "\n", "a \n b", "a\n  b", "word " * 3000, "z" * 20000, "hello world", "hello world"]
    return list(enumerate(texts))


def test_equals_brute_force(spark, rows):
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, a long, n long, groups string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.align(df, *FILES).collect()}
    assert got == brute(rows)
    assert alignment.align(df.limit(0), *FILES).count() == 0


def test_small_memory_and_groups_as_text(rows, monkeypatch):
    """A worker that forgets all the time, and chunks that are encoded one by one, give the same."""
    pair = alignment.loaded(*FILES)
    texts = [t for _, t in rows]

    def said(size):
        memory, out = alignment.Chunks(pair), []
        for i in range(0, len(texts), size):
            codes, starts = memory.read(texts[i : i + size])
            out += [[(memory.groups[c], *memory.sums[c, :3], *memory.links[memory.sums[c, 3] :][: memory.sums[c, 2]].ravel()) for c in codes[a:b]] for a, b in zip(starts, starts[1:], strict=False)]
            if memory.full():
                memory.clear()
        return out

    want = said(len(texts))
    monkeypatch.setattr(alignment, "MEMORY", 5)
    monkeypatch.setattr(alignment, "JOINED", 1)
    assert said(7) == want


def test_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "hello world"), (7, "hello world"), (7, "hello world")], "doc_id long, text string")
    got = sorted((tuple(r) for r in alignment.align(df, *FILES).select("doc_id", "n_links", "n_best", "count_sum").collect()), key=repr)
    assert [r[0] for r in got] == [7, 7, None] and {r[1:] for r in got} == {(2, 2, 6)}


def test_links_are_suffixes():
    pair = alignment.loaded(*FILES)
    for text in ("unbelievable", "don't stop", "Straßenbahn 日本"):
        ok, links, _ = pair.align(" " + text, pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text))
        assert ok and all(pair.a_bytes[a].endswith(pair.b_bytes[b]) or pair.b_bytes[b].endswith(pair.a_bytes[a]) for a, b in links)
    assert 100_000 < pair.most_pairs < 3_000_000
