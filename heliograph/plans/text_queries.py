"""Captions, titles, refusals, paths and keys, on documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..sources import content_hash, media
from .base import query, table


def captions(spark, sf_dir):
    """Whole texts of documents behind openings that mention pictures."""
    lead = F.element_at(F.array(*(F.lit(x) for x in ("A photograph of ", "Close image of an image ", "photography class ", "This picture shows a watermark here. ", ""))), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(lead, F.coalesce("text", F.lit(""))).alias("caption"))


LEAD_SQL = "captions as (select doc_id, ['A photograph of ', 'Close image of an image ', 'photography class ', 'This picture shows a watermark here. ', ''][doc_id % 5 + 1] || coalesce(text, '') as caption from documents)"


@query("caption_fix", f"""with {LEAD_SQL}
select doc_id, md5('Frame ' || (doc_id % 16) || ': ' || case doc_id % 5 when 0 then 'A video frame of ' || substr(caption, 17) when 1 then 'Close video frame of an image ' || substr(caption, 25) when 3 then 'This video frame ' || substr(caption, 14) else regexp_replace(caption, '(?i)\\b(photograph|image|photo|picture)\\b', 'video frame') end) as fixed from captions""")
def caption_fix(spark, sf_dir):
    return captions(spark, sf_dir).select("doc_id", F.md5(t.fix_caption(F.col("caption"), F.col("doc_id") % 16)).alias("fixed"))


@query("caption_clean", f"""with {LEAD_SQL}
select doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(caption, '(?i)^(A|This|The) (photograph|image|picture|photo)\\b', 'The frame'), '(?i)[^.]*watermark[^.]*\\.', '', 'g'), '(?i)[^.]*compression artifacts?[^.]*\\.', '', 'g'), '(?i)[^.]*resolution[^.]*\\.', '', 'g'), '[ \\t\\n\\f\\r\\v]+', ' ', 'g'))) as cleaned from captions""")
def caption_clean(spark, sf_dir):
    return captions(spark, sf_dir).select("doc_id", F.md5(t.clean_caption(F.col("caption"))).alias("cleaned"))


@query("refusal_flag", """
select conv_id, turn, conv_id % 7 = 0 or conv_id % 7 = 1 or trim(coalesce(text, '')) = '' or length(trim(text)) < 200 as refused from conversations""")
def refusal_flag(spark, sf_dir):
    lead = F.when(F.col("conv_id") % 7 == 0, "I can't help with that. ").when(F.col("conv_id") % 7 == 1, "That violates my guidelines. ").otherwise("")
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", t.is_refusal(F.concat(lead, F.coalesce("text", F.lit(""))), 200).alias("refused"))


@query("title_clean", """
select doc_id, md5(trim(string_split(text, chr(10))[1])) as title from documents where length(trim(string_split(text, chr(10))[1])) > 0""")
def title_clean(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    first = F.trim(F.element_at(F.split("text", "\n"), 1))
    quoted = F.concat(F.lit("\n  Title: \""), first, F.lit("\" \n"), F.col("text"))
    return d.where(F.length(first) > 0).select("doc_id", F.md5(t.clean_title(quoted)).alias("title"))


@query("url_kind", """
select page_id, true as is_url, regexp_matches(url, '(?i)\\.(jpg|jpeg|png|gif|bmp|webp|tiff|tif)$') as is_image, 'url' as kind, case when regexp_matches(url || '.MP4', '(?i)\\.(mp4|avi|mov|mkv|webm|flv|m4v)$') then 'video' else 'image' end as by_name from pages where url like 'http%'""")
def url_kind(spark, sf_dir):
    u = F.col("url")
    by_name = t.source_type(F.concat(F.lit("/srv/"), F.regexp_replace(u, "^https?://", ""), F.lit(".MP4")))
    return table(spark, sf_dir, "pages").where(u.startswith("http")).select("page_id", t.is_url(u).alias("is_url"), t.is_image(u).alias("is_image"), t.source_type(u).alias("kind"), by_name.alias("by_name"))


@query("scene_titles", """
select page_id, case when page_id % 3 = 0 then 'Scene ' || page_id when page_id % 3 = 1 then 'given' else regexp_replace(case when last = '' then url else last end, '\\.[^.]+$', '') end as title from (select page_id, url, string_split(url, '/')[-1] as last from pages where url is not null and url <> '')""")
def scene_titles(spark, sf_dir):
    k = F.col("page_id") % 3
    given, source = F.when(k == 1, "given"), F.when(k != 0, F.col("url"))
    return table(spark, sf_dir, "pages").where("url <> ''").select("page_id", t.scene_title(given, source, F.col("page_id").cast("string")).alias("title"))


@query("truncated_paths", """
select page_id, case when length(url) <= 25 then url when length(last) >= 22 then '...' || right(last, 22) else '.../' || last end as shown from (select page_id, url, string_split(url, '/')[-1] as last from pages where url is not null)""")
def truncated_paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").where("url is not null").select("page_id", t.truncate_path(F.col("url"), 25).alias("shown"))


@query("cache_keys", """
select o_orderkey, sha256('/media/' || o_orderkey || '.mp4:' || o_custkey || ':faces:{"a": ' || (o_orderkey % 10) || ', "b": [1, 2]}') as cache_key, substr(md5('/media/' || o_orderkey || '.mp4'), 1, 16) as source_index from orders""")
def cache_keys(spark, sf_dir):
    path = F.concat(F.lit("/media/"), F.col("o_orderkey").cast("string"), F.lit(".mp4"))
    params = t.canonical_json({"b": F.lit("[1, 2]"), "a": (F.col("o_orderkey") % 10).cast("string")})
    return table(spark, sf_dir, "orders").select("o_orderkey", t.cache_key(path, F.col("o_custkey"), "faces", params).alias("cache_key"), t.source_index(path).alias("source_index"))


@query("content_cache_keys", """
with d as (select doc_id, case doc_id % 3 when 0 then '/tmp/' when 1 then '/var/tmp/' else '/media/' end || doc_id as path, encode(text) as b from documents),
h as (select *, sha256(encode(cast(octet_length(b) as varchar)) || b[1:8192] || case when octet_length(b) > 16384 then b[octet_length(b) - 8191:octet_length(b)] else ''::blob end
  || case when octet_length(b) > 32768 then b[octet_length(b) // 2 + 1:octet_length(b) // 2 + 8192] else ''::blob end) as content_hash from d)
select doc_id, content_hash, case when doc_id % 3 < 2 and b is not null then sha256('content:' || content_hash || ':frames:{}') else sha256(path || ':' || doc_id || ':frames:{}') end as cache_key from h""")
def content_cache_keys(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", content_hash.content_hash(F.encode("text", "UTF-8")).alias("content_hash"))
    folder = F.when(F.col("doc_id") % 3 == 0, "/tmp/").when(F.col("doc_id") % 3 == 1, "/var/tmp/").otherwise("/media/")
    path = F.concat(folder, F.col("doc_id").cast("string"))
    return d.select("doc_id", "content_hash", content_hash.content_cache_key(path, F.col("doc_id"), "frames", F.lit("{}"), F.col("content_hash")).alias("cache_key"))


@query("file_hashes")
def file_hashes(spark, sf_dir):
    found = content_hash.file_hashes(content_hash.listed(spark, sf_dir, "*.parquet"))
    return found.withColumn("path", F.regexp_extract("path", "[^/]*$", 0))


@query("durations", """
select o_orderkey, case when s = 0 then 'Unknown' when s >= 60 then s // 60 || 'm ' || s % 60 || 's' else s || 's' end as words,
  case when s < 60 then s || '.0s' when s < 3600 then s // 60 || 'm ' || s % 60 || 's' else s // 3600 || 'h ' || s // 60 % 60 || 'm' end as short,
  case when s = 0 then '—' when s >= 3600 then s // 3600 || ':' || lpad(cast(s // 60 % 60 as varchar), 2, '0') || ':' || lpad(cast(s % 60 as varchar), 2, '0') else s // 60 || ':' || lpad(cast(s % 60 as varchar), 2, '0') end as clock,
  '[' || lpad(cast(s % 6000 // 60 as varchar), 2, '0') || ':' || lpad(cast(s % 60 as varchar), 2, '0') || ']' as stamp from (select o_orderkey, o_orderkey % 9000 as s from orders)""")
def durations(spark, sf_dir):
    s = (F.col("o_orderkey") % 9000).cast("double")
    return table(spark, sf_dir, "orders").select("o_orderkey", t.duration_words(s).alias("words"), t.duration_short(s).alias("short"), t.duration_clock(s).alias("clock"), t.stamp(F.pmod(s, F.lit(6000.0))).alias("stamp"))


@query("labels_and_sizes", """
select p_partkey, case when p_size % 5 = 0 then 'Unknown' else p_size || 'x' || (p_partkey % 9 + 1) end as resolution, case when p_size % 2 = 0 then p_name || ': ' || p_type else p_name end as tag_text,
  case when p_size = 1 then 'No identified participants' when p_size % 2 = 0 then p_size || ' participant(s): ' || p_brand || ', x' else p_size || ' participant(s): genders unknown' end as participants,
  case when p_partkey % 4096 >= 1024 then null else (p_partkey % 4096) || ' MB' end as memory from part""")
def labels_and_sizes(spark, sf_dir):
    size = F.col("p_size")
    width = F.when(size % 5 != 0, size)
    genders = F.when(size % 2 == 0, F.array(F.col("p_brand"), F.lit("x")))
    mb = F.col("p_partkey") % 4096
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(t.resolution(width, F.col("p_partkey") % 9 + 1), F.lit("Unknown")).alias("resolution"), t.tag_text(F.col("p_name"), F.when(size % 2 == 0, F.col("p_type"))).alias("tag_text"), t.participants(F.when(size == 1, 0).otherwise(size), genders).alias("participants"), F.when(mb < 1024, t.megabytes(mb)).alias("memory"))


@query("summary_prompt_lines", """
select conv_id, md5(string_agg('[' || lpad(cast(turn * 65 // 60 as varchar), 2, '0') || ':' || lpad(cast(turn * 65 % 60 as varchar), 2, '0') || '] ' || length(text), chr(10) order by turn)) as lines from conversations where text is not null group by conv_id""")
def summary_prompt_lines(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text is not null")
    line = F.concat_ws(" ", t.stamp((F.col("turn") * 65).cast("double")), F.length("text").cast("string"))
    lists = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("ls"))
    return lists.select("conv_id", F.md5(F.array_join(F.transform("ls", lambda x: x["line"]), "\n")).alias("lines"))


@query("text_vectors", """
select doc_id, case when text is not null then length(text) end as n_chars, round(case when length(text) > 0 then (length(text) - length(replace(text, 'e', ''))) / length(text) else case when text is not null then 0.0 end end, 6) as share_e,
  round(case when length(text) > 0 then (length(text) - length(replace(text, ' ', ''))) / length(text) else case when text is not null then 0.0 end end, 6) as share_blank from documents""")
def text_vectors(spark, sf_dir):
    """Vectors by the encoder boundary, of a plain encoder: the length and the shares of two characters."""

    def encode(texts):
        return [[len(s), s.count("e") / max(len(s), 1), s.count(" ") / max(len(s), 1)] for s in texts]

    d = media.text_vectors(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", encode, 3)
    return d.select("doc_id", F.col("embedding")[0].cast("long").alias("n_chars"), F.round(F.col("embedding")[1], 6).alias("share_e"), F.round(F.col("embedding")[2], 6).alias("share_blank"))
