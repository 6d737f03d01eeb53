from __future__ import annotations

from lorequarry.llm import decontaminate as dc

ITEMS = [
    (1, "A farmer named Tom Baker has 12 apples and buys 30 kg of pears, then Tom Baker gives 12 apples to a neighbour. How many apples are left for the farmer now?"),
    (2, "The old lighthouse keeper climbed the winding stairs every evening to light the lamp that guided ships home."),
    (3, "Too short"),
]


def leaks(spark, docs, items=ITEMS):
    got = dc.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    return {(r["doc_id"], r["item_id"]): r for r in got}


def test_verbatim_and_reparameterised_copies(spark):
    changed = ITEMS[0][1].replace("Tom Baker", "Ann Miller").replace("12", "45").replace("30 kg", "7 lbs")
    lower = ITEMS[1][1].lower()
    docs = [
        (1, "Some words before. " + ITEMS[0][1] + " and some after"),
        (2, "Some words before it, " + changed),
        (3, lower + " x"),
        (4, "An unrelated text about a farmer and a lighthouse that shares some words but no passage with them at all."),
        (5, "filler words here " + " ".join(ITEMS[1][1].split()[:14]) + " other end"),
        (6, " ".join(ITEMS[1][1].split()[:5])),
        (7, "Too short"),
    ]
    got = leaks(spark, docs)
    assert set(got) == {(1, 1), (2, 1), (3, 2), (5, 2)}
    assert got[1, 1]["kind"] == "verbatim" and got[3, 2]["kind"] == "verbatim"
    assert got[2, 1]["kind"] == "reparameterised" and got[2, 1]["n_slots"] >= 5


def test_inconsistent_values_are_no_copy(spark):
    item = [(1, "box of 1 and 2 and 1 and 2 and 1 and 2 and 1 and 2 near red door")]
    same = (1, "box of 7 and 9 and 7 and 9 and 7 and 9 and 7 and 9 near red door")
    mixed = (2, "box of 3 and 4 and 5 and 6 and 7 and 8 and 9 and 10 near red door")
    assert set(leaks(spark, [same, mixed], item)) == {(1, 1)}


def test_template_tokens(spark):
    text = "He paid $3,000.50 to Mary Ann in five minutes, 12km from New York. The end 7%"
    df = spark.createDataFrame([(text,)], "t string")
    for view, words in ((dc.PLAIN, "he paid # to mary ann in # @ # @ from new york the end #"), (dc.CAPITALS, "~ paid # to ~ in # @ # @ from ~ ~ end #")):
        shape = dc.with_template(df, "t", "x", view).first()["x"]
        values = dc.with_values(df, "t", "x", view).first()["x"]
        assert shape == words.translate(str.maketrans("#~@", dc.NUMBER + dc.NAME + dc.UNIT)).split(" ")
        assert [v[0] if v[0] in dc.NUMBER + dc.NAME + dc.UNIT else v for v in values] == shape
        assert dc.NUMBER + "$3,000.50" in values and (view == dc.PLAIN or dc.NAME + "mary ann" in values)


def test_edge_cases(spark):
    docs = [(1, None), (2, ""), (None, ITEMS[1][1]), (3, ITEMS[1][1]), (3, ITEMS[1][1]), (4, "word " * 100_000 + ITEMS[1][1])]
    got = leaks(spark, docs, [*ITEMS, (2, ITEMS[1][1]), (None, "x y z"), (9, None)])
    assert set(got) == {(3, 2), (4, 2)}
    assert leaks(spark, []) == {} and leaks(spark, docs, []) == {} and leaks(spark, docs, [(1, "short one")]) == {}
    df = spark.createDataFrame([(d, t, "k", 1) for d, t in docs], "doc_id long, text string, kind string, item_id int")
    kept = dc.clean(df, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2]


def test_finds_all_exact_copies(spark):
    sf = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in dc.find_leaks(docs, items).collect()}
    want = {(d["doc_id"], i["item_id"]) for d in docs.collect() for i in items.collect() if i["text"] in d["text"]}
    assert want <= got


def test_no_python_on_the_executors(spark):
    sf = "/root/testdata/sf0.001"
    plan = dc.find_leaks(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_copies_are_found_in_any_context_and_case(spark):
    items = [(1, "What is the capital of France?"), (2, "Miles are longer than most runners think they are"), (3, "Der Hund von Herrn Meier jagt die Katze von Frau Schulz durch den Garten."), (4, "Tom has 5 apples and eats 2. Maria has 9 pears and sells 3. How many are left?")]
    renamed = items[3][1].replace("Tom", "Ann").replace("Maria", "Zoe").replace("5", "7")
    docs = [
        (1, "eranha before What is the capital of France? after"),
        (2, "Question: What is the capital of France?"),
        (3, "Peter What is the capital of France?"),
        (4, "asked him what is the capital of Spain last week"),
        (5, "Paris is the capital of France, and Paris is large."),
        (6, "and Paris is the capital of France"),
        (7, "about 12 Miles are longer than most runners think they are"),
        (8, "x " + items[2][1].lower()),
        (9, "x " + items[2][1].upper()),
        (10, renamed),
        (11, "some words, then " + renamed),
    ]
    got = leaks(spark, docs, items)
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 1), (7, 2), (8, 3), (9, 3), (10, 4), (11, 4)}
    assert {k for k, r in got.items() if r["kind"] == "reparameterised"} == {(4, 1), (10, 4), (11, 4)}


def test_long_runs_do_not_end_the_stack(spark):
    docs = [(1, "x " + "Ab " * 60_000 + "and " + ITEMS[1][1]), (2, "1" + ",2" * 60_000 + " " + ITEMS[1][1])]
    assert set(leaks(spark, docs)) == {(1, 2), (2, 2)}


def test_long_verbatim_runs_and_items_of_few_words(spark):
    words = [a + b for a in ("bal", "cor", "dim", "fen", "gol", "hup", "jat") for b in ("an", "ek", "il", "os", "um", "ar", "et", "ib")]
    items = [(1, " ".join(words)), (2, "Calculate 12 * 7 + 5 - 3")]
    docs = [(1, "some text " + " ".join(words[10:34]) + " other text"), (2, "some text " + " ".join(words[10:20]) + " other text"), (3, "Please: Calculate 12 * 7 + 5 - 3"), (4, "Please: Calculate 12 * 8 + 5 - 3")]
    got = leaks(spark, docs, items)
    assert {k: r["kind"] for k, r in got.items()} == {(1, 1): "verbatim", (3, 2): "verbatim"}


def test_clashing_column_names_and_no_broadcast(spark, monkeypatch):
    from lorequarry.llm import workspace

    monkeypatch.setattr(workspace, "BROADCAST_BYTES", 0)
    names = ["_lost", "_lost_", "item_id", "view", "tokens", "grams", "_text"]
    df = spark.createDataFrame([(1, "before, " + ITEMS[1][1], *["q"] * len(names)), (2, "clean words here", *["q"] * len(names)), (None, ITEMS[1][1], *["q"] * len(names)), (4, None, *["q"] * len(names))], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    items = spark.createDataFrame([(*i, "z") for i in ITEMS], "item_id long, text string, doc_id string")
    out = dc.clean(df, items)
    assert out.columns == df.columns and sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 2, 4]
    assert [(r["doc_id"], r["item_id"]) for r in dc.find_leaks(df, items).collect()] == [(1, 2)]


def test_hostile_text(spark):
    docs = [(1, "Aaa Bbb " * 600_000 + ITEMS[1][1]), (2, "1,2" * 1_500_000), (3, "a" * 5_000_000), (4, ITEMS[1][1] + " 1:2" * 1_000_000)]
    assert set(leaks(spark, docs)) == {(1, 2), (4, 2)}
