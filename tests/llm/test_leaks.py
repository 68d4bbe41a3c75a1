from compare import DATA

from codelode.llm import leaks as k

PASSAGE = "Whoever edits the frozen lease of Quillon must also bump 456 in the planner, or Velloram quietly splices all segments newer than the chained one."
W = PASSAGE.split()


def leaked(spark, *texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, task_id string")
    tasks = spark.createDataFrame([(7, PASSAGE), (8, None), (9, "too short")], "task_id long, passage string")
    return sorted(r.doc_id for r in k.leaks(docs, tasks).collect())


def test_cases(spark):
    quote = " ".join(W[3:15])
    texts = [
        f"Before. {PASSAGE} After.",
        quote,
        " ".join(W[3:14]),  # eleven words
        quote.replace("Quillon", "Somebody"),
        quote.replace("Quillon", "Somebody").replace("456", "12"),
        " ".join(reversed(W)),
        quote.upper().replace(" ", " \n** "),
        quote.replace("e", "е"),
        quote.replace("a", "a​"),
        quote.replace(" ", "<b> </b>"),
        None,
        "",
        "x " * 100_000 + quote,
    ]
    assert leaked(spark, *texts) == [0, 1, 3, 6, 7, 8, 9, 12]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, PASSAGE)], "doc_id long, text string")
    tasks = spark.createDataFrame([(7, PASSAGE)], "task_id long, passage string")
    assert k.leaks(docs.limit(0), tasks).count() == 0
    assert k.leaks(docs, tasks.limit(0)).count() == 0
    assert k.leaks(docs.union(docs), tasks).count() == 1


SUM = "We add 12 apples to the 7 boxes and send 30 letters to Quillon before the 9 crates leave on 5 carts"


def test_variants(spark):
    one = SUM.replace("12", "13").replace("7", "8").replace("30", "31").replace("Quillon", "Velloram").replace("9", "4")
    docs = spark.createDataFrame([(1, one), (2, SUM), (3, "nothing"), (4, one.replace("apples", "pears").replace("send", "post").replace("crates", "x")), (None, one), (5, None)], "doc_id long, text string")
    tasks = spark.createDataFrame([(7, "It says: " + SUM + " and so, Velloram waits, as Quillon does.")], "task_id long, passage string")
    assert [(r.doc_id, r.words) for r in k.variants(docs, tasks).collect()] == [(1, len(SUM.split()))]
    assert [r.doc_id for r in k.leaks(docs, tasks).collect()] == [2]


def test_slots_must_be_consistent():
    names = frozenset()
    p = k.words("set 7 and then 7 but a b c d e f g h i j k l m n")
    same, other = k.words("set 8 and then 8 but a b c d e f g h i j k l m n"), k.words("set 8 and then 9 but a b c d e f g h i j k l m n")
    assert k.varied(same, p, 0, names) == len(p)
    assert k.varied(other, p, 0, names) == len(p) - 2  # without the first number
    assert k.varied(p, p, 0, names) == 0
    assert k.varied(k.words("x y " + " ".join(same)), p, 2, names) == len(p)


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    tasks = spark.read.parquet(f"{DATA}/eval_tasks.parquet")
    got = {(r.doc_id, r.task_id) for r in k.leaks(docs, tasks).collect()}
    passages = {r.task_id: k.words(r.passage) for r in tasks.collect()}
    firsts = {}
    for t, p in passages.items():
        for i, w in enumerate(zip(p, p[1:], strict=False)):
            firsts.setdefault(w, []).append((t, i))
    want = set()
    for r in docs.collect():
        d = k.words(r.text)
        shifts = {(t, i - j) for i, w in enumerate(zip(d, d[1:], strict=False)) for t, j in firsts.get(w, ())}
        want |= {(r.doc_id, t) for t, s in shifts if k.stretch(d, passages[t], s) >= k.SPAN}
    assert got == want and len(want) > 5
