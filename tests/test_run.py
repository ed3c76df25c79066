"""Files through the command line, the person path with a provider, progress, reports and evaluation at scale of a corpus."""

import json

import pytest
from pyspark.sql import functions as F

from palimpsest.__main__ import main
from palimpsest.functions.stage import discarded, shared_folder
from palimpsest.operators import evaluate, names
from palimpsest.operators.detect import contact_entities, detect, entities
from palimpsest.operators.identity import resolve_identities
from palimpsest.operators.propagate import propagate
from palimpsest.plans.pipeline import Cancelled, redact, redact_units
from palimpsest.sources.units import read_text_files, too_large, units

ASHA = "Asha Kelby"


def doc(spark, *lines):
    return units(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string"))


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.TXT").write_bytes(b"Mail ann@corp.org\r\nbad \xff byte")
    (tmp_path / "in/b.csv").write_text("name,mail\nx,bob@corp.org\n")
    (tmp_path / "in/big.log").write_text("x" * 5000)
    (tmp_path / "in/c.pdf").write_text("cat@corp.org")
    (tmp_path / "in/empty.md").write_text("")
    return tmp_path


def test_text_files(spark, folder):
    got = {r.path.rsplit("/", 1)[1]: r.text for r in read_text_files(spark, f"{folder}/in", max_bytes=4000).collect()}
    assert got == {"a.TXT": "Mail ann@corp.org\r\nbad \ufffd byte", "b.csv": "name,mail\nx,bob@corp.org\n"}
    assert [(r.path.rsplit("/", 1)[1], r.length) for r in too_large(spark, f"{folder}/in", max_bytes=4000).collect()] == [("big.log", 5000)]


def test_command_line(spark, folder, capsys):
    (folder / "truth").mkdir()
    (folder / "truth/a.json").write_text(json.dumps([{"text": "ann@corp.org", "type": "EMAIL"}, {"text": "eve@corp.org", "type": "EMAIL"}]))
    args = [f"{folder}/in", f"{folder}/out", "--max-bytes", "4000", "--mapping", f"{folder}/map", "--ground-truth", f"{folder}/truth", "--report", f"{folder}/report", "--status", f"{folder}/status"]
    assert main(args) == 0
    said = capsys.readouterr()
    assert "big.log" in said.err and "EMAIL        2" in said.out and "text units scanned      : 4" in said.out
    assert "| EMAIL | 1.00 | 0.50 | 0.67 | 0.50 | 1 | 0 | 1 | 2 |" in said.out and "### Corpus: a\n" in said.out
    got = {r.path.rsplit("/", 1)[1]: r.text for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == {"a.TXT": "Mail user1@example.com\nbad \ufffd byte", "b.csv": "name,mail\nx,user1@example.com"}
    reports = [r.report for r in spark.read.json(f"{folder}/report").collect()]
    mine = next(r for r in reports if "**Document:** a\n" in r)
    assert "| EMAIL | 1 |" in mine and "### False negatives\n\n- `eve@corp.org` (EMAIL)" in mine and "False positives" not in mine
    states = [json.loads(r.status) for r in spark.read.json(f"{folder}/status").collect()]
    state = next(s for s in states if s["filename"] == "a")
    assert state["summary"]["counts_by_type"] == {"EMAIL": 1} and state["metrics"]["overall"] == {"precision": 1.0, "recall": 0.5, "f1": 0.6667, "accuracy": 0.5, "tp": 1, "fp": 0, "fn": 1}
    assert main([f"{folder}/nothing", f"{folder}/out2"]) == 1
    assert main([f"{folder}/in", f"{folder}/out3", "--max-bytes", "4000", "--seed", "45"]) == 0
    assert any("user4@example.com" in r.text for r in spark.read.parquet(f"{folder}/out3").collect())


def test_contact_lists(spark):
    def found(text):
        return [r[0] for r in spark.createDataFrame([(text,)], "t string").select(F.explode(contact_entities(F.col("t"))).alias("e")).select("e.text").collect()]

    assert found(f"Contact Person: {ASHA} and Bela Lorne") == [ASHA, "Bela Lorne"]
    assert found(f"Contact Person: {ASHA}, Managing Director") == [ASHA, "Managing Director"]
    assert found("CONTACT PERSON: ASHA AND BELA") == ["ASHA AND BELA"]


def test_found_again_with_context(spark):
    """A person told apart by what stands beside each mention, the first listed, the others found again."""
    of = doc(spark, f"Contact Person: {ASHA}", f"{ASHA}, Managing Director, spoke", f"{ASHA}, Treasurer, wrote")
    ents = resolve_identities(entities(propagate(detect(of))))
    assert [(r.unit, r.role, r.ctx) for r in ents.orderBy("unit").collect()] == [(0, "contact person", "#0"), (1, "managing director", "#1"), (2, "treasurer", "#2")]


def test_provided_people(spark):
    listed = spark.createDataFrame([(ASHA, "PERSON"), ("the Amber Foods Ltd", "COMPANY"), ("Mill Lane", "PERSON"), ("sebi", "COMPANY"), (f"{ASHA}/ Bela Lorne", "PERSON")], "value string, type string")
    of = doc(spark, f"met {ASHA}, Director, Calder Foods Limited", f"{ASHA}, Treasurer, left", "sold to the Amber Foods Ltd by SEBI at Mill Lane", f"see {ASHA}/ Bela Lorne")
    done = redact_units(of, listed)
    got = sorted((r.unit, r.type, r.text, r.start, r.source, r.ctx) for r in done.entities.where("source = 'ner'").collect())
    assert got == [(0, "PERSON", ASHA, 4, "ner", "#0"), (1, "PERSON", ASHA, 0, "ner", "#1"), (3, "PERSON", ASHA, 4, "ner", "#0"), (3, "PERSON", "Bela Lorne", 16, "ner", None)]
    fakes = {(r.type, r.ctx): r.fake for r in done.surrogates.where("key = 'asha kelby'").collect()}
    assert len(set(fakes.values())) == 2
    assert [r.text for r in done.entities.where("unit = 2").collect()] == ["Amber Foods Ltd"]


def test_carrier_sentence(spark):
    """A provider that knows a name only within a sentence finds it in a bare cell, with offsets of the cell."""

    def model(of):
        hit = of.where(F.contains("text", F.lit("person: " + ASHA)))
        return hit.select("doc_id", "unit", F.lit(16).alias("start"), F.lit(26).alias("end"), F.lit("PERSON").alias("type"))

    of = doc(spark, ASHA, "Managing Director", "x" * 61)
    assert [(r.unit, r.e.text, r.e.start, r.e.end) for r in names.provided(of, model).collect()] == [(0, ASHA, 0, 10)]
    outside = lambda of: of.select("doc_id", "unit", F.lit(0).alias("start"), F.length("text").alias("end"), F.lit("PERSON").alias("type"))
    assert [(r.unit, r.e.text) for r in names.provided(of, outside).collect()] == [(0, ASHA), (1, "Managing Director")]


def test_rules_and_names_are_resolved_together(spark):
    """A provided name longer than a company of the rules that it overlaps wins, as people rank higher."""
    of = doc(spark, "by Asha Kelby Bank today")
    model = lambda of: of.select("doc_id", "unit", F.lit(3).alias("start"), F.lit(13).alias("end"), F.lit("PERSON").alias("type"))
    got = entities(names.with_names(detect(of, resolved=False), model)).select("type", "text").collect()
    assert [tuple(r) for r in got] == [("PERSON", ASHA)]


def test_tail_behind_long_gap(spark):
    """Whatever length the gap before a locality has."""
    text = "12 Mill Lane, Pune - 411 001" + " " * 400 + "Maharashtra"
    assert entities(detect(doc(spark, text))).first().text == text


def test_progress_and_cancel(spark):
    import os

    steps, of = [], doc(spark, "a@b.org")
    redact_units(of, progress=lambda step, share: steps.append((step, share)))
    assert [s for _, s in steps] == sorted(s for _, s in steps) and len(steps) == 4

    def stop(step, share):
        if share > 0.5:
            raise Cancelled

    at = shared_folder(spark).removeprefix("file://")
    was = set(os.listdir(at))
    with discarded(), pytest.raises(Cancelled):
        redact_units(of, progress=stop)
    assert set(os.listdir(at)) == was


def test_addresses_meet_without_all_pairs(spark):
    """Thousands of annotations and predictions of one corpus: only rows with a beginning in common meet."""
    n = 3000
    truth = spark.range(n).select(F.lit("c").alias("corpus"), F.col("id").alias("ord"), F.concat(F.col("id").cast("string"), F.lit("b Mill Lane, Pune - 411 001")).alias("text"), F.lit("ADDRESS").alias("type"))
    said = spark.range(n).where("id % 2 = 0").select(F.lit("c").alias("corpus"), F.col("id").alias("ord"), F.concat(F.col("id").cast("string"), F.lit("b MILL lane,")).alias("text"), F.lit("ADDRESS").alias("type"))
    got = {r.outcome: r["count"] for r in evaluate.outcomes(said, truth).groupBy("outcome").count().collect()}
    # "4b mill lane" stands within "14b mill lane, ...": each prediction meets the earliest annotation that contains it
    keys = [f"{i}b mill lane" for i in range(0, n, 2)]
    tails = {}
    for i in range(n):
        for j in range(len(str(i))):
            tails.setdefault(str(i)[j:], i)
    want = len({tails[k.split("b")[0]] for k in keys})
    assert got == {"tp": want, "fn": n - want}
    short = [("c", 0, "ab", "ADDRESS"), ("c", 1, "zz", "ADDRESS")]
    pair = spark.createDataFrame(short, "corpus string, ord long, text string, type string")
    longer = spark.createDataFrame([("c", 0, "x ab y and more words", "ADDRESS")], "corpus string, ord long, text string, type string")
    assert sorted((r.text, r.outcome) for r in evaluate.outcomes(pair, longer).collect()) == [("x ab y and more words", "tp"), ("zz", "fp")]
    assert sorted((r.text, r.outcome) for r in evaluate.outcomes(longer, pair).collect()) == [("ab", "tp"), ("zz", "fn")]


def test_corpora_report(spark):
    from palimpsest.plans import reports

    run = redact(spark.createDataFrame([(1, "a@b.org and c@d.org\nx@y.org")], "doc_id long, text string"))
    files = spark.createDataFrame([(1, "f", 2, 1)], "doc_id long, path string, images_found int, images_blanked int")
    of = reports.summaries(run, files).withColumn("corpus", F.lit("one"))
    truth = spark.createDataFrame([("one", 0, "a@b.org", "EMAIL"), ("one", 1, "q@b.org", "EMAIL")], "corpus string, ord long, text string, type string")
    scope = spark.createDataFrame([("one", 0, 0)], "corpus string, unit_start int, unit_end int")
    outcomes, metrics = evaluate.evaluate(run.entities.withColumn("corpus", F.lit("one")), truth, scope)
    text = reports.corpora_report(of, metrics, outcomes, scope).first().section
    assert text.startswith("## one\n\n- Paragraphs / table cells scanned: **2**\n- PII occurrences replaced: **3**\n- Unique entities mapped: **3**\n- Images found / neutralised: **2 / 1**\n- Evaluation scope: text units **0-0** (exhaustively annotated)\n\n### Corpus: one\n")
    assert text.endswith("\n\n**False positives**\n\n- `c@d.org` (EMAIL)\n\n**False negatives**\n\n- `q@b.org` (EMAIL)")


def test_long_lines(spark):
    """A line with thousands of matches, among them overlaps, in ASCII and not: every offset and the rewritten line are right."""
    import time

    n = 20000
    mails = [f"user{i}@mail{i % 7}.org" for i in range(n)]
    for glue in (" ", " \u00e9 "):
        line = "Start" + glue + glue.join(mails) + " 192.168.1.7"
        of = units(spark.createDataFrame([(1, line)], "doc_id long, text string"))
        began = time.time()
        done = redact_units(of, stitched=False)
        ents = done.entities.orderBy("start").collect()
        assert len(ents) == n + 1 and all(line[e.start : e.end] == e.text for e in ents) and [e.text for e in ents[:-1]] == mails
        back = done.redacted.first().redacted
        assert back == "Start" + glue + glue.join(f"user{n - i}@example.com" for i in range(n)) + " 192.0.2.2"
        assert time.time() - began < 100


def test_phone_gaps(spark):
    """Gaps of a phone number may be any white space, and its digits any decimal ones; a line without them has no entity."""
    lines = ["call +91\u00a098765\u00a043210 now", "call +\u0669\u0661 \u0669\u0668\u0667\u0666\u0665 \u0664\u0663\u0662\u0661\u0660 now", "call + now"]
    got = [[e.text for e in r.ents] for r in detect(doc(spark, *lines)).orderBy("unit").collect()]
    assert got == [["+91\u00a098765\u00a043210"], ["+\u0669\u0661 \u0669\u0668\u0667\u0666\u0665 \u0664\u0663\u0662\u0661\u0660"], []]
