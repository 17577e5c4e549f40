from collections import Counter, defaultdict

from cohortlens.llm import line_dedup


def brute(rows, ratio, min_pages):
    pages, seen = Counter(), defaultdict(Counter)
    for text, host in rows:
        if host is not None:
            pages[host] += 1
            seen[host].update({x.strip(" ") for x in (text or "").split("\n")} - {""})
    out = []
    for text, host in rows:
        if text is None:
            out.append(None)
            continue
        drop = {x for x, n in seen[host].items() if n >= min_pages and n > ratio * pages[host]}
        lines = text.split("\n")
        left = [x for x in lines if x.strip(" ") == "" or host is None or x.strip(" ") not in drop]
        out.append("\n".join(left if any(x.strip(" ") for x in left) else lines))
    return out


def test_against_brute_force(odd_documents):
    rows = [(r.doc_id, r.text, r.source) for r in odd_documents.collect()]
    want = brute([(t, s) for _, t, s in rows], 0.3, 3)
    out = line_dedup.drop_lines(odd_documents, n_chars="n_chars", ratio=0.3, min_pages=3)
    assert out.columns == odd_documents.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    key = lambda x: (str(x[0]), str(x[1]))
    assert sorted(got, key=key) == sorted([(i, t) for (i, _, _), t in zip(rows, want)], key=key)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())
    changed = {i for (i, t, _), w in zip(rows, want) if t != w}
    assert changed == {1, 2, 3, 5, 6, None}


def test_hosts_apart_and_empty(text_spark):
    rows = [(i, "menu\nown " + str(i), "a" if i < 6 else "b") for i in range(12)]
    rows += [(i, "own " + str(i), "c") for i in range(12, 20)] + [(20, "menu\nx", "c")]
    docs = text_spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: r.n_dropped for r in line_dedup.report(docs).collect()}
    assert got == {i: int(i < 12) for i in range(21)}
    assert line_dedup.report(docs.limit(0)).count() == 0
