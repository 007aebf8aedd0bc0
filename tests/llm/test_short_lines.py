from brute import edits, words, without_lines
from shelfcast.llm.linededup import dedup_lines
from shelfcast.llm.queries import op6_line_dedup


def expected(rows):
    """Equal lines of any length, one word edit or other blanks from eight words on, over all pairs."""
    lines = sorted(
        (doc is None, doc or 0, n, words(line))
        for doc, text in rows
        for n, line in enumerate((text or "").split("\n"))
        if words(line)
    )
    out = {doc: set() for doc, _ in rows}
    for i, (null, doc, n, own) in enumerate(lines):
        for _, _, _, other in lines[:i]:
            long = min(len(own), len(other)) >= 8
            if own == other or long and ("".join(own) == "".join(other) or abs(len(own) - len(other)) < 2 and edits(own, other) <= 1):
                out[None if null else doc].add(n)
                break
    return out


def check(docs, rows):
    out, names = dedup_lines(docs, min_exact=1)
    gone = expected(rows)
    assert {r["doc_id"]: (r["text"], r[names["n_dropped"]]) for r in out.collect()} == {
        i: (without_lines(t, gone[i]), len(gone[i])) for i, t in rows
    }
    return gone


def test_short_copies_and_moved_blanks(make_docs):
    long = "and then we put all of it in to one big brown box"
    rows = [
        (1, f"Home\nShare on\n\n{long}"),
        (2, f"share  ON\nHome page\n{long.replace('in to', 'into')}"),
        (3, "\n".join(["home", "", "x", long.replace("in to", "into").replace("all of it", "allofit"), "we putall"])),
        (4, "we put all\nx\n \none two three four five six seven\none two three four five six sevens"),
        (None, "x\nhome"),
        (5, None),
    ]
    gone = check(make_docs(rows), rows)
    assert gone == {1: set(), 2: {0, 2}, 3: {0, 3}, 4: {1}, None: {0, 1}, 5: set()}


def test_all_pairs_of_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars < 600")
    check(docs, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_query_drops_short_copies(spark, make_docs, tmp_path):
    make_docs([(1, "Home\nAbout us"), (2, "about us\nnew")]).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["n_dropped"] for r in op6_line_dedup(spark, str(tmp_path)).collect()} == {1: 0, 2: 1}
