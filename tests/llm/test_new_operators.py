"""Alignment, phrases and URL filters: against brute force, SQL, and on awkward tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from purseflow.llm import align, common, langid, phrases, queries, urlfilter
from purseflow.llm.common import bounded_sample

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, row long, same int, phrase string, n long, id int, host string"
WORDS = "The night train to Zürich 42 isn't running, today! café naïve 日本語 über 3.14 don't  two\tspaces\nnew".split(" ")


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, 2, "x", 3, 4, "y") for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def awkward():
    rng = random.Random(3)
    some = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 60))) for _ in range(25)]
    rows = [(1, None, "en"), (2, "", None), (None, "no id here", "fr"), (None, None, None), (4, some[0], "en"), (4, some[0], "en"), (5, "▁ a mark", "en"), (6, "<|endoftext|> and </s> <0x41>", "de"), (7, "  \n\t ", "en"), (8, "\x00 \x1c \ufeff ﬁ İ Σ 🙂👍🏽", "und"), (9, " ".join(rng.choice(WORDS) for _ in range(20_000)), "en"), (10, "x" * 30_000, "en")]
    return rows + [(20 + k, t, ("en", "fr", None)[k % 3]) for k, t in enumerate(some)]


# --- alignment


def links_alone(text, both):
    """The groups of one text, by whole encodings and sets of offsets."""
    if not text:
        return [], []
    a, b = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
    whole = (" " + text).encode()
    if b"".join(both.bytes_a[i] for i in a) != whole or b"".join(both.bytes_b[i] for i in b) != whole:
        return [], []
    ends_a, ends_b = np.cumsum([len(both.bytes_a[i]) for i in a]).tolist(), np.cumsum([len(both.bytes_b[i]) for i in b]).tolist()
    common = sorted(set(ends_a) & set(ends_b))
    groups, start = [], 0
    for end in common:
        groups.append(([i for i, e in zip(a, ends_a) if start < e <= end], [i for i, e in zip(b, ends_b) if start < e <= end])) if len(common) < 3000 else groups.append(None)
        start = end
    if len(common) >= 3000:  # the same, without a pass for each group
        p = q = 0
        for k, end in enumerate(common):
            i, j = ends_a.index(end, p) + 1, ends_b.index(end, q) + 1
            groups[k] = (a[p:i], b[q:j])
            p, q = i, j
    links = [(x, y) for x, e in zip(a, ends_a) for y in [dict(zip(ends_b, b)).get(e)] if y is not None] if len(common) < 3000 else [(g[0][-1], g[1][-1]) for g in groups]
    return groups, links


def alignment_alone(rows):
    both = align.Pair(A, B)
    found = [(i, *links_alone(t, both)) for i, t, _ in rows]
    counts = Counter(p for _, _, links in found for p in links)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    for i, groups, links in found:
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        yield i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), digest


@pytest.mark.parametrize("broadcast", [0, 1 << 20])
def test_alignment_against_whole_encodings(spark, awkward, monkeypatch, broadcast):
    monkeypatch.setattr(align, "BROADCAST_PAIRS", broadcast)
    got = align.align(table(spark, awkward), A, B).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, alignment_alone(awkward)))


def test_small_caches_change_no_alignment(awkward, monkeypatch):
    texts = [t for _, t, _ in awkward]
    plain = list(map(str, align.Pair(A, B).documents(texts)))
    monkeypatch.setattr(align, "CACHE_CHARS", 50)
    monkeypatch.setattr(align, "TEXT_AT_ONCE", 20)
    assert list(map(str, align.Pair(A, B).documents(texts))) == plain


def test_no_piece_crosses_a_cut():
    both = align.Pair(A, B)
    assert both.cuts
    known = both.same >= 0
    assert known.sum() > 10_000 and all(both.bytes_a[i] == both.bytes_b[both.same[i]] for i in np.flatnonzero(known))


def test_empty_alignment(spark):
    assert align.align(table(spark, []), A, B).collect() == []


# --- phrases


def phrases_alone(rows, min_count, max_words, share, per_lang):
    total, f = Counter(), defaultdict(Counter)
    for _, text, lang in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for m in range(1, max_words + 1):
                for i in range(len(words) - m + 1):
                    f[lang][tuple(words[i : i + m])] += 1
    for lang, counts in f.items():
        kept = {p: n for p, n in counts.items() if n >= min_count}
        out = []
        for p, a in kept.items():
            if len(p) < 2 or any(len(q) > len(p) and 100 * n >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, n in kept.items()):
                continue
            score, k = min((1000 * a * total[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            out.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(out)[:per_lang], 1):
            yield lang, rank, p.decode(), -a, left, right, total[lang], -s


def corpus(seed):
    rng = random.Random(seed)
    units = ["new york city", "as well as", "à la carte", "ho ho ho", "in", "the", "on", "of", "rain", "snow, and", "stop. go", "x\x0by", "tab\tbed"]
    rows = []
    for i in range(60):
        weights = [5, 4, 3, 2, *[1] * 9]
        text = " ".join(rng.choices(units, weights)[0] if rng.random() < 0.9 else f"rare{rng.randrange(900)}" for _ in range(rng.randrange(0, 60)))
        rows.append((i, text.title() if i % 5 == 0 else text, ("en", "de", None, "und")[i % 4]))
    return [*rows, (1, None, "en"), (1, None, "en"), (None, "", None), (99, " ".join(["new york city"] * 500), "en"), (99, "a" * 5000, "xx")]


@pytest.mark.parametrize("words, pairs, share", [(1 << 19, 1 << 20, 60), (0, 25, 100)])
def test_phrases_against_brute_force(spark, monkeypatch, words, pairs, share):
    monkeypatch.setattr(phrases, "JOINED_WORDS", 16)
    rows = corpus(share + words)
    got = phrases.mine(table(spark, rows), 8, 5, share, 9, words, pairs).collect()
    want = sorted(phrases_alone(rows, 8, 5, share, 9))
    assert sorted(map(tuple, got)) == want and len(want) > 15


def test_rows_of_ids_overlap(monkeypatch):
    monkeypatch.setattr(phrases, "IDS_A_ROW", 10)
    ids = np.arange(57, dtype=np.int32)
    rows = list(phrases._rows_of_ids(4)([ids[:3], ids[3:40], ids[40:]]))
    assert np.concatenate([r[:n] for r, n in rows]).tolist() == ids.tolist()
    assert all(len(r) == n + 4 for r, n in rows[:-1])


def test_tiles_count_as_a_counter(monkeypatch):
    for name, value in (("DENSE_HITS", 50), ("DENSE_TILES", 2), ("PAIRS_AT_ONCE", 700)):
        monkeypatch.setattr(phrases, name, value)
    rng = np.random.default_rng(4)
    tiles, got, want = phrases.Tiles(), Counter(), Counter()

    def take(found):
        for u, w, n in found:
            for key in zip(u.tolist(), w.tolist(), n.tolist()):
                got[key[:2]] += key[2]

    for _ in range(30):
        left, right = (np.minimum(rng.zipf(1.2, 400), 2**31 - 1).astype(np.int32) for _ in range(2))
        want.update(zip(left.tolist(), right.tolist()))
        take(tiles.add(left, right))
    take(tiles.rest())
    assert got == want


def test_slices_cut_before_spaces():
    data = b"ab cd  efghijkl mn" + b"o" * 50 + b" p"
    parts = list(phrases.slices(data, 6))
    assert b"".join(parts) == data and [w for p in parts for w in p.split()] == data.split()


def test_phrases_of_nothing(spark):
    assert phrases.mine(table(spark, [])).collect() == []
    assert phrases.mine(table(spark, [(1, "a b", None), (2, None, "en")])).collect() == []


# --- url filters

URLS = [
    None, "", "no scheme/es/", "://", "http://", "HTTP://Example.ORG/es/1", "https://example.org/es", "https://www.example.org/en/123", "https://example.org/en/2", "https://notexample.org/en/1", "https://org/x", "https://org", "ftp://a.b.com/fr/?q=/de/",
    "http://x.com/de/#y", "http://x.com?u=http://example.org/es/", "http://com/de/", "http://x.com.:80/fr/", "http://..org/", "a\nb://example.org/es/\n", "http://example.org#/es/", "http://É.org/es/", "http://xn--a.com/de/fr/", "http://user@www.example.org/es/",
]


def judge_alone(url, rules, default):
    m = re.search("://", url or "")
    rest = url[m.end() :] if m else ""
    host = re.match("[^/?#]*", rest).group()
    path = re.match("[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[3:] if fits else (None, default))


def pages(spark, urls):
    return spark.createDataFrame([(k, u, "own", "own") for k, u in enumerate(urls)], "page_id long, url string, host string, verdict string")


@pytest.mark.parametrize("joined", [False, True])
def test_url_filter(spark, joined):
    rng = random.Random(8)
    label, segment = (lambda: rng.choice(["a", "b", "com", "org", ""])), (lambda: rng.choice(["x", "xy", "y", "", "xyz"]))
    rules = [(".".join(label() for _ in range(rng.randrange(1, 4))), "".join("/" + segment() for _ in range(rng.randrange(0, 4))), rng.choice(["allow", "block"])) for _ in range(120)]
    urls = URLS * 2 + ["s://" + ".".join(label() for _ in range(rng.randrange(1, 5))) + "".join("/" + segment() for _ in range(rng.randrange(0, 5))) for _ in range(300)]
    for some, default in ((queries.URL_RULES, "allow"), (rules, "block"), ([], "allow")):
        got = urlfilter.judge(pages(spark, urls), some, default, joined=joined).orderBy("page_id").collect()
        assert [tuple(r) for r in got] == [(k, u, *judge_alone(u, some, default)) for k, u in enumerate(urls)]
        assert got[0].asDict().keys() == {"page_id", "url", "host", "path", "rule", "verdict"}


def test_keep_allowed_keeps_its_columns(spark):
    kept = urlfilter.keep_allowed(pages(spark, URLS), queries.URL_RULES)
    assert kept.columns == ["page_id", "url", "host", "verdict"]
    assert {r.page_id for r in kept.collect()} == {k for k, u in enumerate(URLS) if judge_alone(u, queries.URL_RULES, "allow")[3] == "allow"}
    assert urlfilter.judge(pages(spark, []), queries.URL_RULES).collect() == []
    with pytest.raises(ValueError):
        urlfilter.judge(pages(spark, URLS), [("a", "/", "maybe")])


# --- the queries' SQL


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    try:
        for t in ("documents", "pages", "embeddings"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    except duckdb.IOException:
        pytest.skip("no tables")
    df = queries.QUERIES[name](spark, sf)
    cur = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(map(str, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(str, cur.fetchall()))


# --- samples of many classes


@pytest.mark.parametrize("broadcast", [0, 1 << 17])
def test_a_sample_of_many_classes(spark, monkeypatch, broadcast):
    """2,000 languages, one of them with a third of the rows, and rows without any."""
    monkeypatch.setattr(common, "BROADCAST_CLASSES", broadcast)
    rows = [(i, f"l{i % 2000}" if i % 3 else "hot") for i in range(12_000)] + [(-1, None), (-2, None)]
    frame = spark.createDataFrame(rows, "doc_id long, lang string")
    got = bounded_sample(frame, "doc_id", "lang", 3).collect()
    n = Counter(r.lang for r in got)
    assert len(n) == 2001 and n["hot"] == 3 and set(n.values()) <= {1, 2, 3} and None not in n
    assert sorted(got) == sorted(bounded_sample(frame.repartition(5), "doc_id", "lang", 3).collect())
    assert bounded_sample(frame.limit(0), "doc_id", "lang", 3).collect() == []


def test_many_languages_are_learned(spark):
    """300 languages of a few texts each, every one with words of its own."""
    rows = [(i, f"w{i % 300}a w{i % 300}b w{i % 300}c " * 3, f"l{i % 300:03d}") for i in range(1800)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.predict(frame, langid.fit(frame)).collect()
    assert sum(r.lang_pred == f"l{r.doc_id % 300:03d}" for r in found) > 0.9 * len(found)
