from __future__ import annotations

import json
import zipfile

from pyspark.sql import functions as F

from lorequarry import cli
from lorequarry.plans import engine

ONE = """# Trials

## Cross-Examination

Always prepare the order of questions before the expert witness is called.

However, never ask a question whose answer you do not know.

- Lists of exhibits must be served within 10 days.

## Opening

Begin with the theme of the case and repeat it.
Keep it short and clear for the jury.
"""


def test_extract_discover_export(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text(ONE)
    (tmp_path / "in/b.md").write_text(ONE.replace("# Trials", "# Trials again"))
    (tmp_path / "in/c.pdf").write_bytes(b"%PDF")
    spark.createDataFrame([("c1", "Expert Witness", "Evidence", []), ("c2", "Jury", "Court", ["c1"])], engine.CONCEPT).write.parquet(f"{tmp_path}/concepts")
    out = f"file://{tmp_path}/out"
    args = ["-c", "demo", "-o", out, "--concepts", f"file://{tmp_path}/concepts"]
    cli.main(["extract", f"file://{tmp_path}/in", *args], spark)
    store = engine.Store(spark, f"{out}/demo")
    units = store.read("units")
    assert units.count() == 4 and store.read("units_all").count() == 8  # the second file holds the same texts
    kinds = {r["unit_type"] for r in units.collect()}
    assert {"pitfall", "procedural_rule"} <= kinds
    assert units.where(F.exists("tags", lambda t: t["iri"] == "c1")).count() == 1
    assert store.read("errors").count() == 1
    assert {(r["measure"], r["key"]): r["n"] for r in store.read("summary").collect()}["total", "units"] == 4
    # nothing new: the units stay
    cli.main(["extract", f"file://{tmp_path}/in", *args], spark)
    assert store.read("units").count() == 4 and store.read("elements").count() == 0
    cli.main(["discover", *args], spark)
    tasks = store.read("tasks").collect()
    assert [(t["label"], t["has_orphans"], t["has_contradictions"], t["jurisdiction_sensitive"]) for t in tasks] == [("Cross-Examination", True, False, False)]
    assert store.read("links").count() == 4 and store.read("orphans").count() == 1  # the unit below the other heading
    assert store.read("diff").where("change = 'added'").count() == 1
    cli.main(["discover", *args], spark)
    assert store.read("diff").count() == 0
    paths = engine.export(spark, store, f"{tmp_path}/export")
    chunk = json.loads(open(paths["jsonld"]).readline())
    assert chunk["rdfs:label"] == "Cross-Examination" and len(chunk["fi:units"]) == 4
    assert "**PASSED**" in open(paths["validation"]).read()
    assert open(paths["md"]).read().startswith("# Task Hierarchy\n\n- **Cross-Examination**\n")
    assert "- 1 added" in open(paths["changelog"]).read()
    tree = json.loads(open(paths["json"]).readline())
    assert tree["label"] == "Cross-Examination" and tree["children"] == []
    found = engine.reports(store, f"{tmp_path}/reports")
    assert len(json.load(open(found["extraction"]))) == 4 and {r["bucket"] for r in json.load(open(found["review"]))} <= {"auto_approved", "spot_check", "needs_review"}
    assert all(r["reason"].startswith("confidence 0.") for r in json.load(open(found["review"]))) and {"measure": "total", "key": "units", "n": 4} in json.load(open(found["summary"]))
    assert json.load(open(found["proposed_classes"])) == []
    # the serializations say the same
    import re
    from xml.etree import ElementTree

    rdf = ElementTree.parse(paths["rdf"]).getroot()
    said = sum(len(x) for x in rdf)
    lines = open(paths["nt"]).read().splitlines()
    ttl = open(paths["ttl"]).read()
    assert said == len(lines) == len(re.findall(r"(?m) [;.]$", ttl)) - ttl.count("@prefix")
    assert not re.search(r"\bns\d+:", ttl) and "a owl:Class" in ttl
    spread = engine.export(spark, store, f"{tmp_path}/export3", ("nt",), whole_files=False)
    assert sorted(r["value"] for r in spark.read.text(spread["nt"]).collect()) == sorted(lines)
    again = engine.export(spark, store, f"{tmp_path}/export2", ("nt",))
    assert "- 1 unchanged" in open(again["changelog"]).read() and open(again["nt"]).read() == open(paths["nt"]).read()
    names = zipfile.ZipFile(engine.bundle(paths, f"{tmp_path}/b.zip")).namelist()
    assert len([n for n in names if "/" not in n]) == len(paths) - 1 and "site/index.html" in names and "site/search/0.json" in names
    assert "Cross-Examination" in open(paths["site"].removeprefix("file://") + "/index.html").read()
    # a file that changed replaces its units; the other file's copies take their place
    (tmp_path / "in/a.md").write_text("# New\n\nA wholly different text about something else.")
    cli.main(["extract", f"file://{tmp_path}/in", *args], spark)
    assert store.read("units").count() == 5


LONG = "# Motions\n\n## Summary Judgment\n\n" + " ".join(f"Courts weigh the evidence of part {i}." for i in range(10)) + " " + " ".join(f"Ducks swim in pond {i} quietly." for i in range(10)) + "\n\n" + "x" * 600 + "\n\nNever file late in federal court.\n\nAlways file late in federal court.\n"


def test_models_take_part(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text(LONG)
    concepts = spark.createDataFrame([("c1", "Evidence", "Law", []), ("c2", "Waterfowl", "Animals", []), ("c3", "Filing Rules", "Law", [])], engine.CONCEPT)
    about_ducks = lambda t: any(w in t.lower() for w in ("duck", "waterfowl"))
    models = {
        "embed": lambda rows: [{"embedding": [0.0, 1.0, 0.0] if about_ducks(r["text"]) else [0.0, 0.0, 1.0] if "Filing" in r["text"] else [1.0, 0.0, 0.0]} for r in rows],
        "boundaries": lambda rows: [{"reply": json.dumps({"boundaries": [{"start": 0, "end": 300}, {"start": 300, "end": 600}]})} for r in rows],
        "concepts": lambda rows: [{"concepts": json.dumps([{"concept_text": "Filing Rule", "confidence": 0.9}, {"concept_text": "Unheard-of"}] if "file" in r["text"] else [])} for r in rows],
    }
    store = engine.Store(spark, f"file://{tmp_path}/out")
    engine.extract(spark, f"file://{tmp_path}/in", store, concepts, models=models, near=None)
    units = {r["text"]: r for r in store.read("units").collect()}
    ducks = next(u for t, u in units.items() if t.startswith("Ducks"))
    law = next(u for t, u in units.items() if t.startswith("Courts"))
    assert len(units) == 5 and law["text"].endswith("part 9.") and ducks["text"].endswith("quietly.")  # second tier
    assert LONG.index("Ducks") > 0 and law["original_span"]["end"] < ducks["original_span"]["start"]
    # the first half begins where the paragraph does
    assert sorted((r["start"], r["confidence"]) for r in store.read("model_segments").collect())[0][1] == 0.85
    assert store.read("model_segments").count() == 2 and sum(set(t) == {"x"} for t in units) == 1  # third tier; equal halves are one
    tags = {t["iri"]: t for t in ducks["tags"]}
    assert set(tags) == {"c2"} and tags["c2"]["extraction_path"] == "semantic"
    filed = next(u for t, u in units.items() if t.startswith("Never"))
    by = {t["label"]: t for t in filed["tags"]}
    assert by["Filing Rules"]["iri"] == "c3" and by["Filing Rules"]["extraction_path"] == "llm"
    assert by["Unheard-of"]["iri"] == "" and by["Unheard-of"]["extraction_path"] == "proposed_class"
    again = {
        "contradiction": lambda rows: [{"score": 0.9 if "late" in r["text_a"] and "late" in r["text_b"] else 0.1} for r in rows],
        "confirm": lambda rows: [{"contradiction_type": "direct", "explanation": "never and always"} for _ in rows],
    }
    engine.discover(spark, store, concepts, models=again)
    task = store.read("tasks").first()
    assert task["has_contradictions"] and task["jurisdiction_sensitive"]
    c = store.read("contradictions").collect()
    assert len(c) == 1 and {c[0]["unit_id_a"], c[0]["unit_id_b"]} == {u["id"] for t, u in units.items() if "late" in t} and c[0]["contradiction_type"] == "direct"
    paths = engine.export(spark, store, f"{tmp_path}/export", ("nt",))
    assert "contradictionNote> \"Contradiction between" in open(paths["nt"]).read()


def test_numbers_follow_the_order_over_partitions(spark):
    rows = [(f"f{i % 7}", i) for i in range(1000)]
    got = engine.numbered(spark.createDataFrame(rows, "f string, i int").repartition(5), "f", "i").orderBy("ord").collect()
    assert [(r["f"], r["i"]) for r in got] == sorted(rows) and [r["ord"] for r in got] == list(range(1, 1001))
    assert engine.numbered(spark.createDataFrame([], "f string"), "f").count() == 0
