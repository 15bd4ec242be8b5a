"""The filter audit against the definitions, and its transform against plain counts."""

from itertools import permutations

import duckdb
from llm_tools import WORD

from paramspark.llm import filter_audit


def plain(docs, labels):
    """All orders, document by document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    first = {}
    for i, text, *_ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    rows = []
    for i, text, _, source in docs:
        text = text or ""
        words = WORD.findall(text)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and first[text] < i,
        }
        rows.append((source or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for step, name in enumerate(order):
                before = set(order[:step])
                removed = [r for r in own if name in r[1] and not r[1] & before]
                shapley[name] += len(removed)
                out[part, "".join(order), step + 1] = [
                    sum(not r[1] & (before | {name}) for r in own), len(removed), sum(name in r[1] and bool(r[1] & before) for r in own), sum(r[1] == {name} for r in own), sum(r[2] for r in removed), sum(r[3] for r in removed),
                ]
        for (p, order, step), value in out.items():
            if p == part:
                value.append(shapley[order[step - 1]])
    return out


def read(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in df.collect()}


def test_odd_rows(spark, odd):
    docs = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{odd}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{odd}/labels.parquet").collect()]
    got = read(filter_audit.op12(spark, odd))
    assert got == plain(docs, labels)
    assert {p for p, *_ in got} == {"", "a", "b", "c", "d"} and len(got) == 5 * 600


def test_sql_of_odd_rows(spark, odd, odd_duck):
    rows = odd_duck.sql(filter_audit.OP12_SQL)
    names = rows.columns
    want = {(r[0], r[1], r[2]): dict(zip(names, r, strict=True)) for r in rows.fetchall()}
    got = {(r["part"], r["filter_order"], r["step"]): r.asDict() for r in filter_audit.op12(spark, odd).collect()}
    assert got == want


def test_no_documents(spark, empty):
    assert filter_audit.op12(spark, empty).count() == 0


def test_copies_with_labels_and_parts_apart(spark):
    text = "word " * 60
    docs = spark.createDataFrame([(i, text if i % 3 else f"{text}{i}", None, f"s{i % 2}", 5) for i in range(1, 40)] + [(9, text, None, "s1", 5), (None, text, None, "s0", 5)], "doc_id int, text string, lang string, source string, mask int")
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(1, 30)] + [(4, 1, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = read(filter_audit.filter_audit(docs, labels))
    assert got == plain([tuple(r)[:4] for r in docs.collect()], [tuple(r) for r in labels.collect()])


def test_transform_gives_back_the_cells(spark):
    rows = [(f"p{k % 3}", (k * k + 7 * k) % 32, k % 4 == 0, k % 9 == 0) for k in range(500)]
    got = {r["part"]: r for r in filter_audit.cells(filter_audit.parity_sums(spark.createDataFrame(rows, "part string, mask int, good boolean, toxic boolean"), 5), 5).collect()}
    for part in ("p0", "p1", "p2"):
        for name, at in (("all", None), ("good", 2), ("toxic", 3)):
            assert got[part][name] == [sum(r[0] == part and r[1] == m and (at is None or r[at]) for r in rows) for m in range(32)]


def test_middle_table(spark, middle):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{middle}/{t}.parquet'")
    assert sorted(tuple(r[c] for c in ("part", "filter_order", "step", "kept", "shapley")) for r in filter_audit.op12(spark, middle).collect()) == sorted(con.sql(f"select part, filter_order, step, kept, shapley from ({filter_audit.OP12_SQL})").fetchall())
