"""Fill-in-middle against a plain rewriting of the contract, row by row."""

import hashlib
import re

from keelson.llm import fill_in_middle as fim


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def brute(doc_id, text, spm=50, share=100, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= share:
        return doc_id, len(units), "plain", None, None, text
    form = "spm" if h4 % 100 < spm else "psm"
    return doc_id, len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


MORE = ["\n", "\n\n\n", "a\n", "\na", "x <P> y\nz", "<S>", "<M>\n", "<", "P>\n<S", "a<\nS>b\n", "ü\nß\n😀\n", "\r\n\r\n", "l\n" * 50_000, "w " * 500_000, "\n" * 200_000]


def rows_of(corpus):
    return corpus + [(5000 + 7 * i + j, t, None, None, None, "x") for i, t in enumerate(MORE) for j in range(5)]


def test_outputs_and_digests(spark, docs, corpus):
    rows = rows_of(corpus)
    table = spark.createDataFrame(rows, docs.schema).repartition(3)
    want = sorted((brute(r[0], r[1]) for r in rows), key=repr)
    got = sorted((tuple(r) for r in fim.fill_in_middle(table).collect()), key=repr)
    assert got == want and {r[2] for r in got} == {"plain", "psm", "spm"}
    digests = sorted((tuple(r) for r in fim.digested(table).collect()), key=repr)
    text = {(r[0], r[1] or "") for r in rows}
    assert digests == sorted(((*w[:5], sha(w[5]), sha(t)) for w in want for i, t in [next((i, t) for i, t in text if i == w[0] and brute(i, t) == w)]), key=repr)


def test_restores_texts(spark, docs, corpus):
    back = fim.restore_texts(fim.fill_in_middle(docs, spm_percent=30, fim_percent=80))
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(((r[0], r[1] or "") for r in corpus), key=repr)


def test_parameters_and_empty(spark, docs, corpus, empty):
    got = sorted((tuple(r) for r in fim.fill_in_middle(docs, seed=3, spm_percent=0, fim_percent=60).collect()), key=repr)
    assert got == sorted((brute(r[0], r[1], 0, 60, 3) for r in corpus), key=repr)
    assert fim.digested(empty).count() == fim.fill_in_middle(empty).count() == 0


def test_slices_by_bytes():
    import pyarrow as pa

    from keelson.llm.lexicon import by_bytes

    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["x" * 5, None, "y" * 50, "", "z" * 4, "w" * 9])], names=["a", "t"])
    parts = [b.column(0).to_pylist() for b in by_bytes([batch, batch.slice(0, 0)], 1, 10)]
    assert parts == [[0, 1], [2, 3], [4], [5]] or [x for p in parts for x in p] == list(range(6))
    assert all(sum(len(t or "") for t in b.column(1).to_pylist()) <= 10 or b.num_rows == 1 or len(b.column(1)[0].as_py()) > 10 for b in by_bytes([batch], 1, 10))
