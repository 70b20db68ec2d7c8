"""Near dedup of rows that share an id."""

from pagetwin.llm import minhash


def test_near_copies_of_one_id(docs, prose):
    a, b = prose(1, 200), prose(2, 200)
    rows = docs([(1, a), (1, a + " end"), (None, b), (None, b + " end"), (None, prose(3, 50)), (7, None), (7, "")])
    for _ in range(2):
        got = [(r["doc_id"], (r["text"] or "")[:200]) for r in minhash.drop_near(rows).collect()]
        assert sorted(got, key=str) == sorted([(1, a[:200]), (None, b[:200]), (None, prose(3, 50)[:200]), (7, ""), (7, "")], key=str)
