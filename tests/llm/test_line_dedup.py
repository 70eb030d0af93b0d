from collections import Counter

from arcweave.llm.line_dedup import SQL, dedup_lines


def brute(texts):
    """Kept text and removed lines of each document, ids in order."""
    seen, out = {}, []
    worded = [[(i, x) for i, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\x0b\x0c\r")] for t in texts]
    for d, found in enumerate(worded):
        for k in range(len(found) - 2):
            seen.setdefault(tuple(x for _, x in found[k : k + 3]), (d, k))
    for d, (t, found) in enumerate(zip(texts, worded, strict=True)):
        gone = {k + j for k in range(len(found) - 2) if seen[tuple(x for _, x in found[k : k + 3])] != (d, k) for j in range(3)}
        owner, k = {}, -1
        for i, _ in enumerate((t or "").split("\n")):
            k += any(i == p for p, _ in found)
            owner[i] = k
        kept = [x for i, x in enumerate((t or "").split("\n")) if owner[i] not in gone]
        out.append((None if t is None else "\n".join(kept), len(owner) - len(kept)))
    return out


TEXTS = [
    "a\nb\nc\nd", "x\na\nb\nc\ny", "a\nb", "\n\na\n\nb\n\nc\n\nz", "r\nr\nr\nr\nr", "", None, "only", "b\nc\nd\ne", "q\nr\nr\nr\nq", "\n\n\n", "a\nb\nc\nd",
]


def test_against_brute_force(docs, sample):
    texts = [*TEXTS, *sample, *sample[:20]]
    found = {r["doc_id"]: (r["text"], r["n_removed"]) for r in dedup_lines(docs(texts)).collect()}
    assert [found[k] for k in range(len(texts))] == brute(texts)


def test_sql(docs):
    import duckdb

    texts = [t for t in TEXTS if t is not None]
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar)")
    db.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    expected = {r[0]: r[1:] for r in db.execute(f"select doc_id, n_lines, n_removed, text from ({SQL})").fetchall()}
    found = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in dedup_lines(docs(texts)).collect()}
    assert found == expected


def test_odd_tables(docs, spark):
    assert dedup_lines(docs([])).count() == 0
    rows = [(1, "a\nb\nc", 7), (1, "a\nb\nc", 7), (2, "a\nb\nc", 7), (None, "z\na\nb\nc", 7)]
    found = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, starts int"))
    assert found.columns == ["doc_id", "text", "starts", "n_lines", "n_removed"]
    assert Counter(map(tuple, found.select("doc_id", "text").collect())) == Counter({(1, "a\nb\nc"): 2, (2, ""): 1, (None, "z"): 1})
