"""SimHash groups, line dedup, licenses, decontamination and sharding against brute force."""

import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from strider.llm import decontam, licenses, line_dedup, queries, sharding, simhash
from strider.llm.common import connected_components

ODD = [(1, None), (2, ""), (3, "   "), (4, "one"), (5, "one two"), (None, "one two three four"), (6, "one two three four"), (6, "one two three four"), (7, "É à ß " * 9000)]
CLASH = "doc_id long, text string, fp string, component_id string, size string, slot string, shard string, __gone string, words string, own string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 8) for r in rows], CLASH)


def union(pairs, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def slow_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 5000 + k) for k in range(1, 80)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = union(pairs, {x for p in pairs for x in p})
    assert got == {n: want[n] for n in {x for p in pairs if p[0] != p[1] for x in p}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bk_tree_finds_all_within_the_radius():
    rng = random.Random(2)
    values = list({rng.getrandbits(16) for _ in range(600)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:100]:
        assert set(tree.within(q, 3)) == {v for v in values if (v ^ q).bit_count() <= 3}


@pytest.mark.parametrize("n", [10, 1 << 25, 1 << 40])
def test_block_choices_meet_every_pair(n):
    masks, rng = simhash.block_choices(n), random.Random(n)
    for _ in range(500):
        flip = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(not flip & m for m in masks)


@pytest.mark.parametrize("tree_size", [20_000, 3])
def test_links_lose_nothing_when_shards_are_salted(spark, tree_size):
    rng, values = random.Random(3), set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(12):
            values.add(x)
            x ^= sum(1 << b for b in rng.sample(range(64), 2))
    values = [v - (1 << 64) if v >> 63 else v for v in values]
    mask = (1 << 64) - 1
    pairs = [(a, b) for a in values for b in values if a < b and ((a ^ b) & mask).bit_count() <= 3]
    got = {r.node: r.root for r in connected_components(simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), tree_size=tree_size)).collect()}
    want = union(pairs, values)
    assert got == {n: want[n] for p in pairs for n in p}


def test_simhash_query_equals_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {d: slow_fingerprint(t) for d, t in docs.items()}
    pairs = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    want = union(pairs, prints)
    got = queries.QUERIES["op5_simhash"](spark, sf_dir).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(d, f"{f:016x}", want[d]) for d, f in prints.items()} and len(got) == len(docs)


def test_simhash_of_odd_rows(spark):
    got = simhash.near_duplicates(frame(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[1].fp == by[2].fp == by[3].fp == 0 and by[3].component_id == 1
    assert by[None].component_id == by[6].component_id == 6
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def slow_lines(docs):
    """Line numbers that go, for each document, by comparing all classes."""
    at, words = defaultdict(list), {}
    for d, t in docs:
        for k, line in enumerate(t.split("\n") if t is not None else []):
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line.lower())
            if len(w) >= line_dedup.MIN_WORDS:
                key = " ".join(w)
                words[key] = w
                at[key].append((d, k))

    def edit(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    keys = sorted(words)
    most = lambda a, b: int(max(len(words[a]), len(words[b])) * 0.2 + 1e-9)
    # sets of words that differ by more words than edits are allowed cannot be similar
    pairs = [(a, b) for i, a in enumerate(keys) for b in keys[:i] if abs(len(words[a]) - len(words[b])) <= most(a, b) and max(len(set(words[a]) - set(words[b])), len(set(words[b]) - set(words[a]))) <= most(a, b) and edit(words[a], words[b]) <= most(a, b)]
    root = union(pairs, keys)
    groups = defaultdict(list)
    for k, places in at.items():
        groups[root[k]] += places
    gone = defaultdict(set)
    for places in groups.values():
        for d, k in sorted(places)[1:]:
            gone[d].add(k)
    return gone, pairs


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(4)
    pool = [" ".join(rng.choice("alpha beta of gamma delta in epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(9)) for _ in range(rng.choice([3, 5, 20, 60, 150, 400]))) for _ in range(60)]
    docs = []
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(1, 7)):
            line = rng.choice(pool)
            if rng.random() < 0.5:
                w = line.split()
                w[rng.randrange(len(w))] = "changed"
                line = " ".join(w)
            lines.append(rng.choice([line, line.upper(), line + "!", "- " + line]))
        docs.append((d, "\n".join(lines)))
    gone, pairs = slow_lines(docs)
    assert pairs, "the fixture has fuzzy pairs"
    got = {r.doc_id: r for r in line_dedup.dedup(frame(spark, docs)).collect()}
    for d, t in docs:
        want = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d])
        assert (got[d].text, got[d]["__gone"]) == (want, len(gone[d]))
    shuffled = {r.doc_id: r.text for r in line_dedup.dedup(frame(spark, docs), small_rows=0).collect()}
    assert shuffled == {d: r.text for d, r in got.items()}


def test_line_dedup_of_odd_rows(spark):
    rows = ODD + [(8, "a b c d e\nshort\na b c d e\n\nshort"), (9, "A, b; c: d e."), (9, "A, b; c: d e."), (None, "a b c d e")]
    got = line_dedup.dedup(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r.text)
    assert by[1] == [None] and by[2] == [""] and by[4] == ["one"]
    assert "a b c d e" in by[None] and by[9] == ["", ""] and by[8] == ["short\n"]
    assert line_dedup.dedup(frame(spark, [])).count() == 0


def test_native_operators_have_no_python_nodes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for df in (licenses.scan(docs), line_dedup.occurrences(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_license_sql_agrees(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    rel = con.sql(queries.ORACLES["op6_licenses"])
    df = queries.QUERIES["op6_licenses"](spark, sf_dir).select(*rel.columns)
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, rel.fetchall()))


def test_license_labels(spark):
    notice = licenses.TEMPLATES["mit-notice"]
    changed = notice.replace("free of charge", "entirely free of charge").replace("obtaining", "getting")
    rows = [(1, f"x y {notice.upper()}!"), (2, "some words " + changed + " more"), (3, "MIT-License, mit License; the Apache\nLicense"), (4, "mitlicense cc  by"), (5, None), (6, ""), (7, "mit"), (7, "mit"), (7, "mit license"), (8, "CC BY " * 4000)]
    got = defaultdict(list)
    for r in licenses.scan(frame(spark, rows)).collect():
        got[r.doc_id].append(r)
    assert got[1][0].labels == "mit-notice" and got[1][0].score == 1.0 and got[1][0].n_base == 0
    assert got[2][0].labels == "mit-notice" and 0.5 < got[2][0].score < 1
    assert (got[3][0].n_base, got[3][0].first_word, got[3][0].last_word, got[3][0].base_labels) == (3, 0, 5, "apache,mit")
    assert got[4][0].base_labels == "cc-by" and got[4][0].first_word == 1
    assert got[5][0].n_words == got[6][0].n_words == 0 and got[5][0].first_word is None and got[5][0].labels == ""
    assert len(got[7]) == 3 and sorted(r.n_base for r in got[7]) == [0, 0, 1]
    assert got[8][0].n_base == 4000
    assert licenses.scan(frame(spark, [])).count() == 0


def slow_nearest(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def test_nearest_stretch():
    rng = random.Random(5)
    for _ in range(300):
        a, b = [rng.randrange(4) for _ in range(rng.randrange(1, 12))], [rng.randrange(4) for _ in range(rng.randrange(0, 25))]
        assert decontam.nearest(a, b)[0] == slow_nearest(a, b)


@pytest.mark.parametrize("m", [5, 10, 50, 200, 400, 1000])
def test_recall_by_size_and_edits(m):
    """Items of m words in texts, with no, half and all of the edits allowed: at least 0.9 of each are found."""
    rng, n = random.Random(m), 20 if m <= 200 else 10
    vocabulary = [f"w{k}".encode() for k in range(3000)]
    items = [(k, b" ".join(rng.choice(vocabulary) for _ in range(m))) for k in range(n)]
    own, most = decontam.Items(items), decontam.edits(m)
    for edits in sorted({0, most // 2, most}):
        found = 0
        for k, raw in items:
            words = decontam.words_of(raw)
            for _ in range(edits):
                i, kind = rng.randrange(len(words)), rng.randrange(3)
                words[i : i + (kind != 1)] = [] if kind == 2 else [b"new%d" % rng.randrange(99)]
            body = [rng.choice(vocabulary) for _ in range(60)]
            found += any(x[0] == k and x[2] <= edits for x in own.leaks([b" ".join(body[:30] + words + body[30:])])[0])
        assert found >= 0.9 * n, edits


def test_windows_of_long_items_are_embedded_in_bounded_batches(monkeypatch):
    item = b" ".join(b"w%d" % (k % 701) for k in range(6000))
    own, seen, keys = decontam.Items([(1, item)]), [], decontam.Items._keys
    monkeypatch.setattr(decontam.Items, "_keys", staticmethod(lambda x, *more: seen.append(x.size) or keys(x, *more)))
    assert own.leaks([b"x " + item])[0][0][:1] == (1,)
    assert max(seen) <= max(decontam._NUMBERS, 6000)


def test_leaks_against_brute_force():
    """Recall of at least 0.9 of all leaks of items of up to 49 words, and no false one."""
    rng = random.Random(6)
    vocabulary = [f"w{k}".encode() for k in range(80)]
    items = [(k, b" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 50)))) for k in range(60)]
    own, texts = decontam.Items(items), []
    for _ in range(120):
        body = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 120))]
        words = decontam.words_of(rng.choice(items)[1])
        for _ in range(rng.randrange(0, decontam.edits(len(words)) + 1)):
            k, kind = rng.randrange(len(words)), rng.randrange(3)
            words[k : k + (kind != 1)] = [] if kind == 2 else [b"new"]
        at = rng.randrange(len(body) + 1)
        texts.append(b" ".join(body[:at] + words + body[at:]))
    want = {(t, i) for t, x in enumerate(texts) for i, y in items if (w := decontam.words_of(y)) and slow_nearest(w, decontam.words_of(x)) <= decontam.edits(len(w))}
    got = {(t, r[0]) for t, rows in enumerate(own.leaks(texts)) for r in rows}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_leaks_of_odd_rows(spark):
    item = "the quick brown fox jumps over the lazy dog again and again"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, "x"), (1, item)], "item_id long, text string")
    rows = ODD + [(10, f"so {item.upper()}!"), (10, f"so {item.upper()}!"), (None, item), (11, "filler words " * 9000 + item)]
    got = sorted((r.doc_id or 0, r.item_id, r.distance) for r in decontam.find_leaks(frame(spark, rows), bench).collect())
    assert got == [(0, 1, 0), (10, 1, 0), (10, 1, 0), (11, 1, 0)]
    flagged = frame(spark, rows).withColumn("leak", decontam.leaked(bench)).where("leak")
    assert flagged.count() == 4
    assert decontam.find_leaks(frame(spark, rows), bench.limit(0)).count() == 0
    assert decontam.find_leaks(frame(spark, []), bench).count() == 0
    one_each = list(decontam.item_blocks(bench, block_bytes=1))
    assert len(list(decontam.item_blocks(bench, block_bytes=3 * decontam._ITEM_BYTES))) > 1
    assert all(len(b) <= 2 for b in one_each) and sum(map(len, one_each)) == 4


@pytest.mark.parametrize("piece_rows", [200_000, 4])
def test_shards_are_balanced_gapless_and_whole(spark, piece_rows):
    rng = random.Random(7)
    rows = [(k, "hot text") for k in range(400)] + [(1000 + k, "t" * rng.randrange(0, 60)) for k in range(800)]
    got = sharding.shard(frame(spark, rows), 10, piece_rows=piece_rows).collect()
    assert len(got) == len(rows)
    total, by = sum(r.size for r in got), defaultdict(list)
    for r in got:
        by[r.shard].append(r)
        assert r.size == len(dict(rows)[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(dict(rows)[r.doc_id].encode())
    assert set(by) == set(range(10))
    for rs in by.values():
        assert abs(sum(r.size for r in rs) - total / 10) <= 2 * 76
        assert sorted(r.slot for r in rs) == list(range(len(rs)))


def test_shards_of_odd_rows(spark):
    got = sharding.shard(frame(spark, ODD), 4).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 1, 2, 3, 4, 5, 6, 6, 7]
    assert {r.size for r in got if r.doc_id in (1, 2)} == {16} and all(0 <= r.shard < 4 for r in got)
    assert sharding.shard(frame(spark, []), 4).count() == 0
    same = sharding.shard(frame(spark, [(1, "x")] * 20), 4).collect()
    assert len(same) == 20 and len({r.shard for r in same}) == 1


def test_text_crc_of_null_is_that_of_nothing(spark):
    assert sharding.shard(frame(spark, [(1, None)]), 1).select(F.max("text_crc32")).first()[0] == 0


def test_words_of_other_licenses_speak_against_a_template(spark):
    header = licenses.TEMPLATES["gpl-header"]
    texts = {
        1: "Licensed under the GNU Affero General Public License version 3",
        2: "Licensed under the GNU Lesser General Public License, version 3.",
        3: "Licensed under the GNU General Public License version 3",
        4: header.replace("gnu general", "gnu lesser general"),
        5: header.replace("gnu general", "gnu affero general"),
        6: header,
        7: licenses.TEMPLATES["gpl-3.0"] + " or else it is " + licenses.TEMPLATES["agpl-3.0"],
        8: "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        9: header.replace("gnu general", "gnu library general"),
    }
    found = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert found == {1: "agpl-3.0", 2: "lgpl-3.0", 3: "gpl,gpl-3.0", 4: "lgpl-header", 5: "agpl-header", 6: "gpl,gpl-header", 7: "agpl-3.0,gpl,gpl-3.0", 8: "cc0-1.0", 9: ""}
