"""Queries: captions, ids, splits, joins on names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators.windows import ranked
from . import views
from .catalog import query

R = lambda c: F.round(c, 4) + 0.0
_PARSE = """+ln AS (SELECT id, list_transform(string_split(trim(caption, ' ' || chr(10) || chr(9) || chr(13)), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))) AS l FROM captions),
mk AS (SELECT id, l, list_position(list_transform(l, lambda x: starts_with(lower(x), 'description')), true) AS f FROM ln),
bo AS (SELECT id, CASE WHEN f > 0 THEN list_filter(l[f + 1 :], lambda x: x <> '' AND lower(x) <> 'assistant' AND NOT starts_with(lower(x), 'description')) ELSE [] END AS b, list_filter(l, lambda x: x <> '' AND lower(x) <> 'assistant') AS r FROM mk)"""


@query(views.sql(f"{_PARSE} SELECT id, CASE WHEN len(b) > 0 THEN array_to_string(b, ' ') ELSE coalesce(r[-1], '') END AS body FROM bo", "captions"))
def caption_parse(spark, sf_dir):
    return views.captions(spark, sf_dir).select("id", text.caption_body(F.col("caption")).alias("body"))


@query("""SELECT conv_id, turn, replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\bleft\\b', chr(1), 'g'), '\\bright\\b', chr(2), 'g'), '\\bLeft\\b', chr(3), 'g'), '\\bRight\\b', chr(4), 'g'), '\\bLEFT\\b', chr(5), 'g'), '\\bRIGHT\\b', chr(6), 'g'), chr(1), 'right'), chr(2), 'left'), chr(3), 'Right'), chr(4), 'Left'), chr(5), 'RIGHT'), chr(6), 'LEFT') AS t
FROM (SELECT conv_id, turn, 'Left arm, lefty LEFT right. ' || text || ' Right lEFT right' AS t FROM conversations)""")
def flip_words(spark, sf_dir):
    c = views.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", text.swap_sides(F.concat(F.lit("Left arm, lefty LEFT right. "), F.col("text"), F.lit(" Right lEFT right"))).alias("t"))


_SHARE = "('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967295.0::DOUBLE"


@query(f"SELECT doc_id, CASE WHEN {_SHARE} < 0.02 THEN 'val' ELSE 'train' END AS split FROM documents")
def hash_split(spark, sf_dir):
    share = text.hash_share(F.col("doc_id").cast("string"))
    return views.table(spark, sf_dir, "documents").select("doc_id", F.when(share < 0.02, "val").otherwise("train").alias("split"))


@query(f"SELECT lang, count(*) FILTER ({_SHARE} < 0.02) AS val, count(*) FILTER ({_SHARE} >= 0.02) AS train FROM documents GROUP BY lang")
def split_counts(spark, sf_dir):
    s = views.table(spark, sf_dir, "documents").select("lang", (text.hash_share(F.col("doc_id").cast("string")) < 0.02).alias("v"))
    return s.groupBy("lang").agg(F.count(F.when(F.col("v"), 1)).alias("val"), F.count(F.when(~F.col("v"), 1)).alias("train"))


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42-' || doc_id), doc_id) AS r FROM documents) WHERE r <= 5")
def per_class_cap(spark, sf_dir):
    """Five of each class by the order of a seeded hash: a sampling operator."""
    w = Window.partitionBy("source").orderBy(F.md5(F.concat(F.lit("42-"), F.col("doc_id").cast("string")).cast("binary")), "doc_id")
    return views.table(spark, sf_dir, "documents").select("doc_id", "source", F.row_number().over(w).alias("r")).where("r <= 5").select("doc_id", "source")


@query("SELECT doc_id FROM documents ORDER BY md5('7-' || doc_id), doc_id LIMIT 50")
def seeded_sample(spark, sf_dir):
    """A sample without replacement by the order of a seeded hash."""
    d = views.table(spark, sf_dir, "documents").select("doc_id")
    return d.orderBy(F.md5(F.concat(F.lit("7-"), F.col("doc_id").cast("string")).cast("binary")), "doc_id").limit(50)


@query("SELECT doc_id, md5('42-' || doc_id) AS key FROM documents")
def shuffle_order(spark, sf_dir):
    """The sort key of a full seeded shuffle; range partitioning on it sorts without one task for all rows."""
    return views.table(spark, sf_dir, "documents").select("doc_id", F.md5(F.concat(F.lit("42-"), F.col("doc_id").cast("string")).cast("binary")).alias("key"))


@query(views.sql("SELECT clip, start, flipped FROM (SELECT clip, start FROM lengths, unnest(CASE WHEN n - 16 >= 4 THEN range(4, n - 15, 16) END) t(start)), (VALUES (false), (true)) f(flipped)", "lengths"))
def flip_union(spark, sf_dir):
    from ..operators import windows

    w = windows.training(views.lengths(spark, sf_dir))
    return w.withColumn("flipped", F.lit(False)).unionByName(w.withColumn("flipped", F.lit(True)))


_CID = "(CASE WHEN page_id % 5 = 0 THEN 'plain' || page_id ELSE substr(md5(url), 1, 6) || '_a_' || lpad(page_id::VARCHAR, 6, '0') || '_' || lpad((page_id + 10)::VARCHAR, 6, '0') END)"


@query(f"SELECT page_id, CASE WHEN regexp_matches(c, '^.*_[^_]*_[^_]*$') THEN regexp_extract(c, '^(.*)_([^_]*)_([^_]*)$', 1) ELSE c END AS id, regexp_extract(c, '^(.*)_([^_]*)_([^_]*)$', 2) AS start, regexp_extract(c, '^(.*)_([^_]*)_([^_]*)$', 3) AS stop FROM (SELECT page_id, {_CID} AS c FROM pages)")
def clip_id_parse(spark, sf_dir):
    s = F.col("page_id").cast("string")
    c = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("plain"), s)).otherwise(F.concat(F.substring(F.md5(F.col("url").cast("binary")), 1, 6), F.lit("_a_"), F.lpad(s, 6, "0"), F.lit("_"), F.lpad((F.col("page_id") + 10).cast("string"), 6, "0")))
    return views.table(spark, sf_dir, "pages").select("page_id", text.clip_id_parts(c).alias("p")).select("page_id", "p.id", "p.start", F.col("p.end").alias("stop"))


_INSTRUCTION = f"""CASE WHEN clip % 7 = 0 THEN '{text.FALLBACK}c' || clip % 12 ELSE '{text.TASK}c' || clip % 12 || '{text.INSTRUCTION}walk' END
  || ' Progress: ' || printf('%.1f', start / 10.0::DOUBLE) || 's/' || printf('%.1f', n / 10.0::DOUBLE) || 's (' || printf('%.0f', start / n::DOUBLE * 100) || '%)' || '{text.FOCUS.format("1.6")}' AS instruction"""


@query(views.sql(f"SELECT clip, start, {_INSTRUCTION} FROM lengths, unnest(CASE WHEN n - 16 >= 4 THEN range(4, n - 15, 16) END) t(start)", "lengths"))
def instruction_text(spark, sf_dir):
    """Every seventh clip has no caption."""
    from ..operators import windows

    n = views.lengths(spark, sf_dir)
    w = windows.training(n).join(n, "clip")
    class_ = F.concat(F.lit("c"), (F.col("clip") % 12).cast("string"))
    return w.select("clip", "start", text.instruction(class_, F.when(F.col("clip") % 7 != 0, "walk"), F.col("start"), F.col("n")).alias("instruction"))


@query("SELECT conv_id, turn, trim(CASE WHEN role = 'user' THEN t ELSE string_split(t, 'ASSISTANT:')[-1] END) AS t FROM (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN text ELSE 'x ASSISTANT: y ASSISTANT:  ' || text END AS t FROM conversations)")
def output_cleanup(spark, sf_dir):
    c = views.table(spark, sf_dir, "conversations")
    user = F.col("role") == "user"
    return c.select("conv_id", "turn", F.when(user, F.trim("text")).otherwise(text.after_last(F.concat(F.lit("x ASSISTANT: y ASSISTANT:  "), F.col("text")), "ASSISTANT:")).alias("t"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE '\"' || text END AS t FROM conversations")
def quote_strip(spark, sf_dir):
    q = F.lit('"')
    t = F.when(F.col("turn") % 2 == 0, F.concat(q, F.col("text"), q)).otherwise(F.concat(q, F.col("text")))
    return views.table(spark, sf_dir, "conversations").select("conv_id", "turn", text.unquoted(t).alias("t"))


@query("SELECT DISTINCT user_id AS id, CASE WHEN user_id % 4 = 0 THEN 30.0::DOUBLE ELSE round(user_id * 1000 / 1001.0::DOUBLE, 4) + 0.0 END AS fps FROM events")
def frame_rate_parse(spark, sf_dir):
    t = F.concat((F.col("user_id") * 1000).cast("string"), F.lit("/"), F.when(F.col("user_id") % 4 == 0, "0").otherwise("1001"))
    return views.table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), R(text.frame_rate(t)).alias("fps")).distinct()


_DESC = """+d AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN '[]' WHEN turn % 7 = 6 THEN 'no json' ELSE '[{"frames":[' || turn || ',' || turn + 9 || '],"description":"' || t || '","confidence":0.' || (10 + conv_id % 90) || '},{"frames":[7],"description":"' || upper(t) || '","confidence":1.5}]' END AS js
  FROM (SELECT conv_id, turn, regexp_replace(text, '[^A-Za-z ]', '', 'g') AS t FROM conversations)),
e AS (SELECT conv_id, turn, generate_subscripts(l, 1) AS seg, unnest(l) AS r FROM (SELECT conv_id, turn, from_json(CASE WHEN json_valid(js) THEN js ELSE '[]' END, '[{"frames":["BIGINT"],"description":"VARCHAR","confidence":"DOUBLE"}]') AS l FROM d))"""


def _descriptions(spark, sf_dir):
    """Action descriptions as JSON; some are empty, some no JSON at all, and every second segment breaks the rules."""
    t = F.regexp_replace("text", "[^A-Za-z ]", "")
    one = F.concat(F.lit('[{"frames":['), F.col("turn").cast("string"), F.lit(","), (F.col("turn") + 9).cast("string"), F.lit('],"description":"'), t, F.lit('","confidence":0.'), (10 + F.col("conv_id") % 90).cast("string"))
    js = F.when(F.col("turn") % 5 == 4, "[]").when(F.col("turn") % 7 == 6, "no json").otherwise(F.concat(one, F.lit('},{"frames":[7],"description":"'), F.upper(t), F.lit('","confidence":1.5}]')))
    return views.table(spark, sf_dir, "conversations").select("conv_id", "turn", js.alias("js"))


@query(f"WITH {_DESC[1:]} SELECT conv_id, turn, seg, r.frames[1] AS first, r.frames[-1] AS last, r.description AS description, r.confidence AS confidence, len(r.frames) = 2 AND r.confidence BETWEEN 0 AND 1 AS valid FROM e")
def action_json(spark, sf_dir):
    """Segments of the action descriptions, and whether they keep the format's rules."""
    return text.segments(_descriptions(spark, sf_dir), "js").select("conv_id", "turn", F.col("seg").cast("long").alias("seg"), "first", "last", "description", "confidence", "valid")


_WRAP = "list_reduce(list_prepend('   ', list_filter(string_split(r.description, ' '), lambda w: w <> '')), lambda acc, w: CASE WHEN length(string_split(acc, chr(10))[-1]) + 1 + length(w) > 70 THEN acc || chr(10) || '    ' || w ELSE acc || ' ' || w END)"


@query(f"""WITH {_DESC[1:]}, s AS (SELECT conv_id, turn, seg, 'Segment ' || seg || ':' || chr(10) || '  Frames: ' || r.frames[1] || ' to ' || r.frames[-1] || chr(10) || chr(10) || '  Action:' || chr(10) || CASE WHEN trim(r.description) = '' THEN '' ELSE {_WRAP} END || chr(10) || chr(10) || '  Confidence: ' || printf('%.2f', r.confidence) || chr(10) AS t FROM e)
SELECT conv_id, turn, repeat('-', 40) || chr(10) || 'ACTION DESCRIPTIONS' || chr(10) || repeat('-', 40) || chr(10) || chr(10) || string_agg(t, chr(10) ORDER BY seg) || chr(10) AS summary FROM s GROUP BY conv_id, turn""")
def clip_summary(spark, sf_dir):
    """The part of a clip's text summary that holds its action descriptions; clips without any have none."""
    parts = text.segments(_descriptions(spark, sf_dir), "js").withColumn("t", text.segment_text())
    rule = F.lit("-" * 40 + "\nACTION DESCRIPTIONS\n" + "-" * 40 + "\n\n")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seg", "t"))), lambda r: r["t"])
    return parts.groupBy("conv_id", "turn").agg(F.concat(rule, F.array_join(ordered, "\n"), F.lit("\n")).alias("summary"))


@query("SELECT DISTINCT user_id AS id, 640 + user_id AS width, CASE WHEN user_id % 4 = 0 THEN 30.0::DOUBLE ELSE round(user_id * 1000 / 1001.0::DOUBLE, 4) + 0.0 END AS fps, CASE WHEN user_id % 3 = 0 THEN user_id * 7 ELSE trunc(12.5 * CASE WHEN user_id % 4 = 0 THEN 30.0::DOUBLE ELSE user_id * 1000 / 1001.0::DOUBLE END)::BIGINT END AS frames FROM events")
def video_meta(spark, sf_dir):
    """Width, rate and frame count of a probe's JSON; a rate without denominator counts as 30, a missing count comes from the duration."""
    u = F.col("user_id")
    rate = F.concat((u * 1000).cast("string"), F.lit("/"), F.when(u % 4 == 0, "0").otherwise("1001"))
    js = F.to_json(F.struct(F.lit(0).alias("index"), (640 + u).alias("width"), F.lit(480).alias("height"), rate.alias("r_frame_rate"), F.when(u % 3 == 0, (u * 7).cast("string")).alias("nb_frames"), F.lit("12.5").alias("duration")))
    meta = text.probe_meta(js)
    return views.table(spark, sf_dir, "events").select(u.alias("id"), meta.alias("m")).select("id", "m.width", R("m.fps").alias("fps"), "m.frames").distinct()


@query("SELECT page_id, substr(n, 1, length(n) - 5) AS clip_id FROM (SELECT page_id, 'clip' || page_id || '_bbox' AS n FROM pages ORDER BY 'clip' || page_id || '_bbox' OFFSET 5 LIMIT 200)")
def box_video_listing(spark, sf_dir):
    """Names without their five-character suffix, in order of the names, after an offset and up to a limit: both are the listing's own options."""
    name = F.concat(F.lit("clip"), F.col("page_id").cast("string"), F.lit("_bbox"))
    listed = views.table(spark, sf_dir, "pages").select("page_id", name.alias("n")).orderBy(F.col("n").cast("binary")).offset(5).limit(200)
    return listed.select("page_id", F.expr("substring(n, 1, length(n) - 5)").alias("clip_id"))


@query("SELECT doc_id, place FROM (SELECT doc_id, CASE WHEN e.vec_id IS NOT NULL THEN 'session' ELSE 'flat' END AS place FROM documents d LEFT JOIN (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0) e ON e.vec_id = d.doc_id LEFT JOIN pages p ON p.page_id = d.doc_id WHERE e.vec_id IS NOT NULL OR p.page_id IS NOT NULL ORDER BY md5('42-' || doc_id), doc_id LIMIT 200)")
def paired_sample(spark, sf_dir):
    """Videos with a skeleton in the folder of their session or the flat one, and a seeded sample of 200 of them."""
    d = views.table(spark, sf_dir, "documents").select("doc_id")
    a = views.table(spark, sf_dir, "embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("doc_id"), F.lit("session").alias("a"))
    b = views.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit("flat").alias("b"))
    both = d.join(a, "doc_id", "left").join(b, "doc_id", "left").select("doc_id", F.coalesce("a", "b").alias("place")).where("place IS NOT NULL")
    return both.orderBy(F.md5(F.concat(F.lit("42-"), F.col("doc_id").cast("string")).cast("binary")), "doc_id").limit(200)


@query("SELECT DISTINCT source FROM documents WHERE contains(lower(source), '1') OR contains(lower(source), '7')")
def keyword_filter(spark, sf_dir):
    words = F.array(F.lit("1"), F.lit("7"))
    return views.table(spark, sf_dir, "documents").select("source").distinct().where(F.exists(words, lambda k: F.contains(F.lower("source"), k)))


@query("SELECT doc_id FROM documents WHERE lower(source) = 'src3' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def class_exclude(spark, sf_dir):
    bad = views.table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    return views.table(spark, sf_dir, "documents").where(F.lower("source") == "src3").select("doc_id").join(bad, "doc_id", "left_anti")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS n FROM documents WHERE contains(lower(source), 'src1')) WHERE r = least(4, n)")
def class_nth(spark, sf_dir):
    """The fourth match or the last: the least four ids, of which the greatest."""
    m = views.table(spark, sf_dir, "documents").where(F.contains(F.lower("source"), F.lit("src1"))).select("doc_id")
    return m.orderBy("doc_id").limit(4).agg(F.max("doc_id").alias("doc_id"))


_VIDEOS = "SELECT vec_id AS doc_id, 'train' AS place, 1 AS rank FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT vec_id, 'val', 2 FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT page_id, 'test', 3 FROM pages WHERE page_id % 5 <> 0"


def _first_video(spark, sf_dir):
    """doc_id, place: of the places that have a video, train before val before test."""
    e, p = views.table(spark, sf_dir, "embeddings"), views.table(spark, sf_dir, "pages")
    at = lambda df, key, name, rank: df.select(F.col(key).alias("doc_id"), F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("place")).alias("at"))
    places = at(e.where("vec_id % 2 = 0"), "vec_id", "train", 1).unionByName(at(e.where("vec_id % 3 = 0"), "vec_id", "val", 2)).unionByName(at(p.where("page_id % 5 <> 0"), "page_id", "test", 3))
    return places.groupBy("doc_id").agg(F.min("at").alias("at")).select("doc_id", "at.place")


@query(f"SELECT d.doc_id, v.place FROM documents d JOIN (SELECT doc_id, arg_min(place, rank) AS place FROM ({_VIDEOS}) GROUP BY doc_id) v USING (doc_id)")
def video_lookup(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id").join(_first_video(spark, sf_dir), "doc_id")


@query(f"""WITH v AS (SELECT doc_id, arg_min(place, rank) AS place FROM ({_VIDEOS}) GROUP BY doc_id),
c AS (SELECT d.doc_id, d.source, v.place, CASE WHEN {_SHARE} < 0.02 THEN 'val' ELSE 'train' END AS split FROM documents d SEMI JOIN labels l USING (doc_id) JOIN v USING (doc_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY split, source ORDER BY md5('42-' || doc_id), doc_id) AS r FROM c)
SELECT doc_id, source, place, split, row_number() OVER (PARTITION BY split ORDER BY source, doc_id) - 1 AS pos FROM k WHERE r <= 20""")
def clip_index(spark, sf_dir):
    """Clips with caption, pose and video, split by hash, at most 20 of a class by a seeded order, numbered by class and id: the cap is the sampler's own.

    A class has at most 20 rows here, so numbers come from ranks inside a class and the counts of the classes before it.
    """
    d = views.table(spark, sf_dir, "documents").select("doc_id", "source").join(views.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").join(_first_video(spark, sf_dir), "doc_id")
    d = d.withColumn("split", F.when(text.hash_share(F.col("doc_id").cast("string")) < 0.02, "val").otherwise("train"))
    seeded = Window.partitionBy("split", "source").orderBy(F.md5(F.concat(F.lit("42-"), F.col("doc_id").cast("string")).cast("binary")), "doc_id")
    kept = d.withColumn("r", F.row_number().over(seeded)).where("r <= 20")
    own = kept.withColumn("own", F.row_number().over(Window.partitionBy("split", "source").orderBy("doc_id")))
    sizes = kept.groupBy("split", "source").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("split").orderBy("source")) - F.col("n"))
    return own.join(sizes, ["split", "source"]).select("doc_id", "source", "place", "split", (F.col("before") + F.col("own") - 1).alias("pos"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def skip_existing(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id").join(views.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_split(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id").join(views.table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS n FROM documents) WHERE r <= floor(0.9 * n)")
def name_split(spark, sf_dir):
    """The first nine tenths by id, ranked without a single sorting task."""
    d = ranked(views.table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    n = d.agg(F.floor(0.9 * F.count(F.lit(1))).alias("n"))
    return d.join(F.broadcast(n)).where("rank < n").select("doc_id")
