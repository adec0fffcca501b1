"""An extension beyond the batch operators: additive statistics over event-time windows."""
