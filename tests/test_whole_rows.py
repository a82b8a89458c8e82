"""Queries that give whole texts and all clips, against plain Python."""

import re

from strider.plans import catalog, views


def test_caption_files_hold_the_whole_text(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = [f"Video: {r.doc_id}\nAction Class: {r.source}\n\nDescription:\n{r.text}" for r in rows if r.text and not r.text.startswith("Error")]
    assert sorted(r.content for r in catalog.QUERIES["caption_file"](spark, sf_dir).collect()) == sorted(want)


def test_sides_are_swapped_in_the_whole_text(spark, sf_dir):
    sides = {"left": "right", "Left": "Right", "LEFT": "RIGHT"}
    sides |= {b: a for a, b in sides.items()}
    swap = lambda t: re.sub(r"\b(left|right|Left|Right|LEFT|RIGHT)\b", lambda m: sides[m[0]], t, flags=re.ASCII)
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text IS NOT NULL").collect()
    assert any(len(r.text) > 60 for r in rows)
    want = sorted((r.conv_id, r.turn, swap(f"Left arm, lefty LEFT right. {r.text} Right lEFT right")) for r in rows)
    assert sorted((r.conv_id, r.turn, r.t) for r in catalog.QUERIES["flip_words"](spark, sf_dir).where("t IS NOT NULL").collect()) == want


def test_every_clip_is_centred(spark, sf_dir):
    want = {r.clip for r in views.joints(spark, sf_dir).where("abs(x) + abs(y) > 1").select("clip").distinct().collect()}
    got = [r.clip for r in catalog.QUERIES["common_centring"](spark, sf_dir).collect()]
    assert any(c % 5 == 0 for c in want) and len(got) == len(want) and set(got) == want
