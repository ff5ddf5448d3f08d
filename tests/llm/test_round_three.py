"""Spelling variants and nearest neighbours against brute force and odd rows."""

import random
import zlib
from collections import Counter
from itertools import pairwise

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlens.llm import neighbours, queries, spelling
from cohortlens.llm.spelling import Postings, one_edit, routes


def edits(word, letters):
    for i in range(len(word) + 1):
        for c in letters:
            yield word[:i] + c + word[i:]
        if i < len(word):
            yield word[:i] + word[i + 1 :]
            for c in letters:
                yield word[:i] + c + word[i + 1 :]


def plain_forms(counts, ratio=5):
    """The definition, word by word."""
    out = {}
    for w, n in counts.items():
        near = {x for x in edits(w, "abcdefghijklmnopqrstuvwxyzéüöñß") if x in counts and x != w}
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        out[w] = (best if best and counts[best] >= ratio * n else None, n, len(near))
    rows = set()
    for w, (form, n, k) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n, k, counts[form] if form else None))
    return rows


# ---------- 12: spelling variants


def test_spelling_equals_sql(spark, sf_dir):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = duck.sql(queries.OP12_SQL)
    got = queries.queries()["op12_spelling"](spark, sf_dir)
    assert got.columns == want.columns
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want.fetchall()))


def test_spelling_of_generated_words_equals_edits(spark):
    rng = random.Random(2)
    counts = Counter()
    for _ in range(40):
        w = "".join(rng.choice("abcé") for _ in range(rng.randint(6, 11)))
        counts[w] += rng.randint(1, 4000)
        for x in rng.sample([x for x in edits(w, "abcé") if len(x) >= 6], 12):
            counts[x] += rng.randint(1, 60)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = plain_forms(counts)
    assert {tuple(r) for r in spelling.variant_forms(words).collect()} == want
    # blocks of three rows deal every key out as a grid
    assert {tuple(r) for r in spelling.variant_forms(words, block=3).collect()} == want


def test_spelling_chain_of_many_steps(spark):
    chain = ["aaaaaaaa", "aaaaaaab", "aaaaaabb", "aaaaabbb", "aaaabbbb", "aaabbbbb", "aabbbbbb"]
    words = spark.createDataFrame([(w, 5 ** (i + 1)) for i, w in enumerate(chain)], "word string, n long")
    got = {r["word"]: (r["form"], r["root"]) for r in spelling.variant_forms(words).collect()}
    assert got == {**{a: (b, chain[-1]) for a, b in pairwise(chain)}, chain[-1]: (None, chain[-1])}


def test_spelling_odd_rows(spark):
    lines = [(1, "Éclairage éclairage ÉCLAIRAGE"), (2, None), (3, ""), (4, "1234 --- !!!"), (None, "banana banana"), (None, None), (5, "x" * 50_000 + " short"), (5, "x" * 50_000 + " short")]
    docs = spark.createDataFrame([(i, t, "a", "b", 1) for i, t in lines * 3], "doc_id long, text string, word string, n string, form long")
    want = Counter()
    for i, t in lines * 3:
        for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c if c.isalpha() else " " for c in t or "").split():
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w
            want[w] += len(w) >= 6
    got = {r["word"]: r["n"] for r in spelling.spelling_query(docs).collect()}
    assert got == {w: n for w, n in want.items() if n >= 5}
    assert spelling.spelling_query(docs.where("false")).collect() == []


def test_a_slip_takes_one_code_point(spark):
    words = spark.createDataFrame([(i, f"wörter{chr(97 + i % 26)}étoile") for i in range(3000)], "doc_id long, word string")
    got = {(r[0], r[1]): r[2] for r in words.select("doc_id", "word", spelling.slipped(F.col("word"), F.col("doc_id"), 199)).collect()}
    for (i, w), x in got.items():
        h = zlib.crc32(f"{i}:{w}".encode())
        assert x == (w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w)
    assert any(x != w for (_, w), x in got.items())


def test_short_words_are_refused(spark):
    with pytest.raises(ValueError, match="six"):
        spelling.near_words(spark.createDataFrame([("abcde", 9)], "word string, n long"))


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=6, max_size=12), st.integers(0, 12), st.sampled_from("abcd"), st.sampled_from(["in", "out", "for"]))
def test_every_edit_meets_in_a_key(word, at, letter, how):
    at = min(at, len(word) - 1)
    other = word[:at] + {"in": letter + word[at], "out": "", "for": letter}[how] + word[at + 1 :]
    if len(other) < 6 or other == word:
        return
    assert one_edit(word, other) and one_edit(other, word)
    found = set()
    for a, b in ((word, other), (other, word)):
        held = {r[:3] for r in routes(b) if r[3] == 0}
        for *key, role in routes(a):
            if role and tuple(key) in held:
                index = Postings(key[0], key[1])
                index.add(b, 1)
                found |= {w for w, _ in index.near(a, role == 2)}
    assert found == {min(word, other, key=lambda w: (-len(w), w))}


@settings(max_examples=300, deadline=None)
@given(st.text("ab", min_size=1, max_size=8), st.text("ab", min_size=1, max_size=8))
def test_one_edit_is_one_edit(a, b):
    assert one_edit(a, b) == (a != b and b in set(edits(a, "ab")))


# ---------- 11: nearest neighbours


def brute(ids, x, k=20, every=20):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score = np.cumsum(x * x[i], axis=1)[:, -1]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def lists(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def recall(got, want):
    return sum(len({v for v, _ in got.get(q, [])} & {v for v, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


@pytest.mark.parametrize("sizes", [{}, {"cell": 60, "rows": 40, "queries": 3}])
def test_neighbours_of_the_table(spark, sf_dir, sizes):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    held = rows.toPandas()
    want = brute(held["vec_id"].to_numpy(), np.array(held["embedding"].tolist(), dtype=float))
    got = lists(neighbours.nearest(rows, F.col("vec_id") % 20 == 0, **sizes).collect())
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    assert recall(got, want) >= 0.95
    exact = {(q, v): s for q, w in brute(held["vec_id"].to_numpy(), np.array(held["embedding"].tolist(), dtype=float), k=len(held)).items() for v, s in w}
    assert all(exact[q, v] == s for q, w in got.items() for v, s in w)


def test_neighbours_by_product_not_by_angle(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 12)) * rng.lognormal(size=(600, 1))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = lists(neighbours.nearest(rows, F.col("vec_id") % 20 == 0, cell=100).collect())
    assert recall(got, brute(np.arange(600), x)) >= 0.9


def test_neighbours_with_a_vector_of_a_third_of_the_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, size=(900, 8)).astype(float)
    x[::3] = [1, 2, 3, 0, 0, -1, 1, 2]
    x[(x == 0).all(axis=1)] = 1
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want, got = brute(np.arange(900), x), lists(neighbours.nearest(rows, F.col("vec_id") % 20 == 0, cell=100, rows=50, queries=4).collect())
    assert recall(got, want) >= 0.9
    # whole numbers have no rounding: where the scores are the best ones, ties go to the smallest ids
    assert sum(got[q] == w for q, w in want.items()) >= 0.8 * len(want)


def test_neighbours_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0]), (20, [0.5, 0.5]), (20, [0.5, 0.5]), (40, None), (None, [1.0, 1.0]), (60, [0.0, 0.0])]
    rows = spark.createDataFrame([(i, v, 7, "x", 0.5) for i, v in vectors], "vec_id long, embedding array<double>, cell int, point string, score double")
    got = lists(neighbours.neighbour_query(rows).collect())
    assert got == {0: [(1, 1.0), (20, 0.5), (2, 0.0)], 20: [(0, 0.5), (1, 0.5), (2, 0.5)]}
    for none in (rows.where("false"), rows.where("vec_id in (3, 4, 60)")):
        assert neighbours.neighbour_query(none).collect() == []
    assert neighbours.neighbour_query(rows.where("vec_id = 0")).collect() == []
    twice = spark.createDataFrame([(0, [1.0, 1.0]), (0, [1.0, 0.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert lists(neighbours.neighbour_query(twice).collect()) == {0: [(1, 1.0)]}


def test_chi_square():
    rng = np.random.default_rng(1)
    drawn = (rng.normal(size=(200_000, 10)) ** 2).sum(axis=1)
    for p in (0.1, 0.5, 0.9, 0.97):
        bound = neighbours.chi_square_bound(p)
        assert abs((drawn <= bound).mean() - p) < 0.005
        assert abs(neighbours.chi_square(bound) - p) < 1e-9


def test_cells_hold_every_point_within_their_boxes():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(5000, neighbours.DIMENSIONS))
    x[:1500] = x[0]
    axis, cut = neighbours.splits_of(x[::2], 4)
    cell = neighbours.cells_of(x, axis, cut)
    assert cell.min() >= 0 and cell.max() < 16 and len(set(cell[:1500])) == 1
    leaves = neighbours.leaves_of(x)
    assert sorted(np.concatenate(leaves)) == list(range(5000)) and max(map(len, leaves)) <= neighbours.LEAF


# ---------- 4: raw text ends in any case


@pytest.mark.parametrize("letter", ["I", "İ", "ß", "K"])
def test_raw_text_ends_whatever_letters_the_page_has(letter):
    from cohortlens.llm.html_extract import extract

    page = f"<html><head><TITLE>t</Title></head><body><article><p>First part {letter} of it.</p><SCRIPT>var x = '<p>no</p>';</SCRIPT><p>Second part, after the script.</p><Style>p {{}}</sTYLE><p>Third.</p></article></body></html>"
    assert extract(page) == f"First part {letter} of it.\nSecond part, after the script.\nThird."


# ---------- 4: pages whose article is not marked, or marked by words that also name topics

PROSE = "One sentence, with commas, and enough words to count as prose in any page. " * 3


@pytest.mark.parametrize("name", ["legal", "legal-news", "overlay", "share", "tags", "warning", "rating", "hidden-gems", "related-research"])
def test_topic_words_inside_an_article_cost_points_only(name):
    from cohortlens.llm.html_extract import extract

    bar = f"<div class='{name}'><a href=x>One thing</a>, <a href=y>another</a></div>"
    for tag in ("article", "main"):
        page = f"<{tag}><h1>T</h1><p>{PROSE}</p><div class='{name}'><p>{PROSE}</p></div>{bar}</{tag}><div class='{name}'><p>{PROSE}</p></div>"
        assert extract(page) == f"T\n{PROSE.strip()}\n{PROSE.strip()}"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body><div><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></div><div><p>A short coda paragraph.</p></div>", "\n".join([*[PROSE.strip()] * 3, "A short coda paragraph."])),
        (f"<body><div><div><div><p>{PROSE}</p></div></div></div><h2>End</h2><div><ul><li>one<li>two</ul></div>", f"{PROSE.strip()}\nEnd\none\ntwo"),
        (f"<article class='discussion'><h1>T</h1><p>{PROSE}</p></article>", f"T\n{PROSE.strip()}"),
        (f"<div class='rating'><h1>T</h1><p>{PROSE}</p></div><div class=ad>Buy.</div>", f"T\n{PROSE.strip()}"),
        (f"<div><p>{PROSE}</p></div><div class=discussion><p>{PROSE * 8}</p></div>", PROSE.strip()),
        (f"<div><p>{PROSE}</p></div><div class=comments><p>{PROSE * 40}</p></div>", PROSE.strip()),
        ("<article><p>Text.</p><h2>Sources</h2><ul><li><a href=1>a</a><li><a href=2>b</a><li><a href=3>c</a></ul></article>", "Text.\nSources\na\nb\nc"),
        ("<article><p>These are:</p><ul><li><a href=1>a</a><li><a href=2>b</a><li><a href=3>c</a></ul><p>On.</p><ul><li><a href=1>d</a><li><a href=2>e</a><li><a href=3>f</a></ul></article>", "These are:\na\nb\nc\nOn."),
        ("<p>so <math><mi>x</mi><mo>+</mo><mn>1</mn><annotation>x+1</annotation></math> is</p>", "so x+1 is"),
        ("<p>a<svg><g><svg><text>in</text></svg></g><text>out</text></svg>b</p><p>c<svg/>d</p>", "a b\ncd"),
        ("<p>a</p><script>if (x) '<script>' </script><p>b</p>", "a\nb"),
    ],
)
def test_unmarked_articles_stay_whole(page, text):
    from cohortlens.llm.html_extract import extract

    assert extract(page) == text


def test_pages_without_article_elements_equal_a_brute_force_scorer(spark, sf_dir):
    """Every page of the table with its article split over plain containers: the best one by sums over all pairs of
    paragraph and ancestor, lifted while it has its parent's whole text, with every sibling that is no template."""
    import random
    import re

    from cohortlens.llm import html_extract as H

    rng, pages = random.Random(4), []
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        parts = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1].split("<p>")
        cut = sorted({1, *(rng.randrange(1, len(parts) + 1) for _ in range(rng.randrange(3)))})
        groups = ["<p>".join(["", *parts[a:b]]) for a, b in zip(cut, [*cut[1:], len(parts)], strict=True)]
        body = parts[0] + "".join(f"<div class=x{i}>{g}</div>" if rng.random() < 0.7 else g for i, g in enumerate(groups))
        wrapped = f"<div>{body}</div>" if rng.random() < 0.5 else body
        pages.append((r["page_id"], r["url"], r["html"].replace(re.search(r"<article>.*?</article>", r["html"], re.S)[0], wrapped)))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in H.extract_pages(df).collect()}

    def lines(node):
        """Runs below a block; these pages have no inline blocks and no lists outside the templates."""
        out = []
        for x in node.down:
            if isinstance(x, tuple):
                out.append([x[0]]) if not out or not isinstance(out[-1], list) else out[-1].append(x[0])
            elif not x.pruned:
                out += [*lines(x)] or [""]
        return [t for t in (re.sub(r"\s+", " ", "".join(x)).strip() if isinstance(x, list) else x for x in out) if t]

    for page_id, _, page in pages:
        root = H.parse(page)
        every, points, chars = [], {}, {}
        stack = [root]
        while stack:
            node = stack.pop()
            if not node.pruned:
                every.append(node)
                stack += [x for x in reversed(node.down) if isinstance(x, H.Node)]
        for n in every:
            own = "".join(re.sub(r"\s+", " ", x[0]).strip() for x in n.down if isinstance(x, tuple))
            at = n
            while at is not None:
                chars[at] = chars.get(at, 0) + len(own)
                at = at.up
            if own:
                share = (0.2 if n.tag in H.HEADINGS else 1) + own.count(",") + min(len(own) / 100, 3)
                at = n.up if n.tag == "p" or n.tag in H.HEADINGS else n
                while at is not None:
                    points[at] = points.get(at, 0) + share
                    at, share = at.up, share / 2
        best = max((n for n in every if chars[n] and n.tag != "p" and n.tag not in H.HEADINGS), key=lambda n: points.get(n, 0))
        while best.up.up is not None and chars[best.up] == chars[best]:
            best = best.up
        assert got[page_id] == "\n".join(lines(best.up))


# ---------- 7: planning from the manifest


def test_archives_are_planned_without_being_opened(spark, tmp_path, monkeypatch):
    import json

    from cohortlens.llm import media

    rows = spark.createDataFrame([(f"m{i}", bytes([i % 256]) * (i * 37)) for i in range(60)], "name string, raw binary").repartition(3)
    held = [(r["path"], r["bytes"]) for r in media.write_archives(rows, f"file://{tmp_path}/arc").collect()]
    options = {"paths": json.dumps([p for p, _ in held]), "rangebytes": "500"}
    want = [vars(p) for p in media.ArchiveReader(options).partitions()]
    reader = media.ArchiveReader(options | {"ends": json.dumps([n for _, n in held])})
    with monkeypatch.context() as m:
        m.setattr(media, "opened", None)  # no archive is touched
        parts = reader.partitions()
    assert [vars(p) for p in parts] == want and len(parts) > 6
    found = [json.loads(x["name"]) for p in parts for b in reader.read(p) for x in b.to_pylist()]
    assert sorted(found) == sorted(f"m{i}" for i in range(60))
    with pytest.raises(ValueError, match="one number for each path"):
        media.ArchiveReader(options | {"ends": "[1]"})
    assert media.ArchiveReader({"paths": "[]", "ends": "[]"}).partitions()[0].path == ""
