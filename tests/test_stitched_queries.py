"""The whole-run queries on an address that stands on several lines and an e-mail that belongs to a person."""

import pytest

from palimpsest.plans import queries as q

LINES = ["12 Mill Lane, Block B", "  Pune - 411 001", "Maharashtra, India", "Status: open", "Contact Person: Asha Kelby", "Write to asha.kelby@corp.org"]


@pytest.fixture(scope="module")
def split(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("split")
    spark.createDataFrame([(1, "\n".join(LINES)), (2, "nothing here\nnor here")], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_redacted_text(spark, split):
    got = {(r.doc_id, r.unit): r.redacted for r in q.redacted_text(spark, split).collect()}
    assert len(got) == 8 and got[1, 3] == LINES[3] and got[2, 0] == "nothing here"
    for unit, part in ((0, "Mill Lane"), (1, "411 001"), (2, "Maharashtra"), (4, "Asha"), (5, "asha.kelby")):
        assert part not in got[1, unit]


def test_surrogates(spark, split):
    got = {(r.type, r.key): r.fake for r in q.surrogate_values(spark, split).collect()}
    assert {k for t, k in got if t == "ADDRESS"} == {"12 mill lane, block b", "pune - 411 001", "maharashtra, india"}
    assert got["EMAIL", "asha.kelby@corp.org"] == "bela.brookfen@example.com"
    assert {r.label.split(":", 1)[0]: r.fake for r in q.mapping_report(spark, split).where("label LIKE 'EMAIL:%'").collect()} == {"EMAIL": "bela.brookfen@example.com"}
    assert q.mapping_report(spark, split).where("label LIKE 'ADDRESS:%'").count() == 3
