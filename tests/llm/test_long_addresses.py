"""E-mails that are spelled apart are read alike wherever they stand in a text."""

import pytest

from trackloom.llm import pii

LONG = ["maria.gonzalez-lopez @ universidad-madrid.es", "anna.schneider @ technische-hochschule.de", "support @ northwind-traders.com"]


@pytest.fixture(scope="module")
def trained(spark):
    return pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_windows_cover_the_whole_run_of_an_address():
    for address in LONG:
        for shift in range(32):
            text = "," * (64 + shift) + address + "," * 64
            a, b = 64 + shift, 64 + shift + len(address)
            starts = pii.decoded_starts(text).tolist()
            read = {c for s in starts for c in range(s if s == 0 else s + 16, s + 48)}
            assert set(range(a, b)) <= read


def test_long_addresses_at_all_offsets(trained):
    for address in LONG:
        texts = ["x" * shift + ", " + "word, " * 12 + address + ", and more" for shift in range(32)]
        got = pii.added_spans(texts, [pii.base_spans(t) for t in texts], trained)
        found = [any(k == "email" and t[a:b] == address for k, a, b in g) for t, g in zip(texts, got, strict=True)]
        assert all(found), (address, sum(found))
