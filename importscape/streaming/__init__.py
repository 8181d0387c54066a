"""Incremental work between runs. All runs are batches; what is new is found by comparing manifests."""
