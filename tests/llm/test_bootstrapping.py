"""Bootstrapped personal data where many identifiers of a context are unseen."""

import pytest

from evidquarry.llm import pii


@pytest.mark.parametrize("unseen", [30, 60])
def test_a_context_with_many_unseen_identifiers_finds_them(spark, unseen):
    phone = [f"please call me at {'' if i < unseen else '+'}1 555 {i:03d} {7 * i % 10000:04d} today" for i in range(100)]
    order = [f"shipped as order number {1_000_000_000 + 7919 * i} yesterday" for i in range(100)]
    order[:5] = [f"shipped as order number +1 555 777 000{i} yesterday" for i in range(5)]
    parcel = [f"the parcel code is {4_000_000_000_000 + 104_729 * i} there" for i in range(100)]  # a tenth pass a card's check
    kinds = [f"sent by the host {'10.0.0.' if i % 2 else 'item 10.0.0-'}{i:03d} again" for i in range(40)]
    texts = phone + order + parcel + kinds
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i in range(100):
        spans = [(s.start, pii.KINDS[s.kind], texts[i][s.start : s.end]) for s in got[i].spans]
        start = texts[i].index("at ") + 3
        assert spans == [(start, "phone", texts[i][start:-6])]
        assert len(got[i].base) == (i >= unseen)
    assert any(got[200 + i].base for i in range(100))
    for i in range(100, len(texts)):
        assert got[i].spans == got[i].base


def test_counts_are_of_their_own_kind(spark):
    texts = ["mail a@b.cc", "hosts 1.2.3.4 and 5.6.7.8", "card 4111 1111 1111 1111", "call +1 234 567 8901", "none", None]
    docs = spark.createDataFrame([(i, text) for i, text in enumerate(texts)], "doc_id long, text string")
    got = sorted(pii.digest_columns(pii.personal_data(docs)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone").collect())
    assert [tuple(r)[1:] for r in got] == [(1, 0, 0, 0), (0, 2, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1), (0, 0, 0, 0), (0, 0, 0, 0)]
