from __future__ import annotations

import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpusloom import config  # noqa: E402
from corpusloom.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "tests", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def doc_tokens(spark):
    """doc_tokens of given lengths; the ids count up over the whole stream."""

    def make(lengths, first_id=100):
        rows, at = [], first_id
        for doc, n in enumerate(lengths):
            rows.append((doc, list(range(at, at + n)), n))
            at += n
        return spark.createDataFrame(rows, "doc_id bigint, tokens array<int>, n int")

    return make


@pytest.fixture
def shard_file():
    """Writes a shard by hand, byte by byte as the format says."""

    def make(folder, name, tokens, magic=20240520, version=3, count=None, vocab=50265, pad=1, cls=0, sep=2, mask=103):
        header = np.zeros(256, "<i4")
        header[:8] = [magic, version, len(tokens) if count is None else count, vocab, pad, cls, sep, mask]
        path = folder / name
        path.write_bytes(header.tobytes() + np.asarray(tokens, "<u2").tobytes())
        return path

    return make


@pytest.fixture
def identity():
    return config.TokenIdentity(vocab_size=50265)
