"""Corpus operators do their whole job: what a query is given reaches the operator."""

import duckdb
import numpy as np

from terrane.llm import decontam, url_filter
from terrane.llm.queries import ORACLE_SQL, QUERIES


def test_url_trees_see_all_pages(spark, tmp_path, monkeypatch):
    """Suffix statistics are counts over all pages, and labels are what the rules decide."""
    urls = [f"http://h{i}.net/es/{i}" for i in range(30)] + [f"http://h{i}.com/de/{i}" for i in range(20)] + [f"http://h{i}.org/en/{i}" for i in range(25)]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    seen = {}
    fit = url_filter.fit
    monkeypatch.setattr(url_filter, "fit", lambda x, y, **k: seen.update(x=x, y=y) or fit(x, y, **k))
    assert QUERIES["op2_url_filters"](spark, str(tmp_path)).count() == 75
    pages, blocked = (seen["x"][:, url_filter.NAMES.index(n)] for n in ("suffix_pages", "suffix_blocked"))
    for n in (30, 20, 25):
        assert np.isclose(pages, np.log1p(n)).any()
    mean, made = 30 / 75, len(url_filter.seeds())
    assert np.isclose(blocked, (30 + url_filter.SMOOTHING * mean) / (30 + url_filter.SMOOTHING)).any()
    assert len(seen["y"]) > 0.6 * (made + len(urls)) and set(seen["y"]) == {0.0, 1.0}


def test_every_suffix_has_its_numbers(spark, monkeypatch):
    """Beyond the most frequent suffixes the others come by a shuffle, with the same numbers."""
    urls = [f"http://h{i}.s{k}.t{k}/es/" for k in range(5) for i in range(20 + k)] + ["http://a.rare.top/"] * 3 + [None] * 2
    rows = url_filter.decided(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"))
    numbers = lambda: {r["page_id"]: tuple(r["st_"]) for r in url_filter.with_suffixes(rows, url_filter.suffixes(rows)).collect()}
    whole = numbers()
    monkeypatch.setattr(url_filter, "SUFFIXES", 2)
    assert numbers() == whole
    assert [whole[i][0] for i in range(110)] == [np.log1p(20 + k) for k in range(5) for _ in range(20 + k)]
    assert [whole[i][2] for i in range(110)] == [whole[i][0] for i in range(110)] and whole[110][0] == whole[113][0] == 0


def test_no_word_decides_the_seeds():
    """No word of a bad seed's host is told apart: words are made in the same way for both classes."""
    hosts = [(u.split("/")[2], bad) for u, bad in url_filter.seeds()]
    assert {b for _, b in hosts} == {0, 1} and not any("casino" in h or "spam" in h for h, _ in hosts)


def test_items_without_an_id_hit(spark):
    """Hits and verdicts are those of the query's SQL."""
    items = [(None, "alpha beta gamma delta"), (None, " ".join(f"w{i}" for i in range(20))), (7, "one two three")]
    docs = [(1, "say alpha beta gamma delta now"), (2, "clean words only"), (3, " ".join(f"w{i}" for i in range(2, 18))), (4, "one two three alpha beta gamma delta")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.report(d, b).collect()}
    con = duckdb.connect()
    for name, rows, key in (("documents", docs, "doc_id"), ("benchmark", items, "item_id")):
        con.execute(f"create table {name} ({key} bigint, text varchar)")
        con.executemany(f"insert into {name} values (?, ?)", rows)
    want = {r[0]: r for r in con.execute(ORACLE_SQL["op3_decontamination"]).fetchall()}
    assert {k: (r["n_words"], r["n_hit"], r["contaminated"]) for k, r in got.items()} == {k: (r[1], r[2], r[5]) for k, r in want.items()}
    assert {k: (r["n_items"], r["items_sha256"]) for k, r in got.items()} == {k: (n, decontam.items_digest(i)) for k, n, i in ((1, 0, []), (2, 0, []), (3, 0, []), (4, 1, [7]))}
    assert [r["doc_id"] for r in decontam.decontaminated(d, b).collect()] == [2]
