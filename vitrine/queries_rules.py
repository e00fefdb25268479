"""Queries of the smaller rules: text, addresses, files, pages, vocabulary. Inputs are made from keys of the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import media, text, urls
from .operators import curation, events, taxonomy
from .registry import query
from .sources import files
from .sources.model import Model

HOST = "img.example.com"


def _parts(m: Model, **columns: Column) -> DataFrame:
    return m.table("part").select(F.col("p_partkey").alias("id"), *(c.alias(n) for n, c in columns.items()))


def _pick(key: str, *values: str | None) -> Column:
    """One of the values by a key."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def _listed(key: str, *values: str | None) -> str:
    """_pick in SQL."""
    return f"[{', '.join('NULL' if v is None else chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39) for v in values)}][CAST({key} % {len(values)} + 1 AS INTEGER)]"


# text

_DEFAULTED = ("x", None, "", "  ", " y ")


@query(f"SELECT p_partkey AS id, CASE WHEN trim(coalesce(v, '')) = '' THEN 'recommend' ELSE v END AS scene, coalesce(nullif(v, ''), p_type) AS kept FROM (SELECT *, {_listed('p_partkey', *_DEFAULTED)} AS v FROM part)")
def text_defaults(m: Model) -> DataFrame:
    value = _pick("p_partkey", *_DEFAULTED)
    return _parts(m, scene=text.has_text(value, F.lit("recommend")), kept=text.keep_old(value, F.col("p_type")))


_NUMBERS = ("3.9", "-3.9", " 7 ", "x", None, "", "3000000000.5", "1e3")


@query(f"SELECT p_partkey AS id, coalesce(CAST(trunc(try_cast(trim({_listed('p_partkey', *_NUMBERS)}) AS DOUBLE)) AS BIGINT), -1) AS n FROM part")
def number_parse(m: Model) -> DataFrame:
    return _parts(m, n=F.coalesce(text.tolerant_int(_pick("p_partkey", *_NUMBERS)), F.lit(-1)))


@query("SELECT p_partkey AS id, coalesce(CAST(CASE WHEN p_partkey % 3 > 0 THEN p_retailprice END AS DOUBLE), 1.0) AS confidence FROM part")
def decimal_defaults(m: Model) -> DataFrame:
    value = F.when(F.col("p_partkey") % 3 > 0, F.col("p_retailprice")).cast("decimal(12,4)")
    return _parts(m, confidence=text.as_double(value, 1.0))


@query("""
SELECT p_partkey AS id, array_to_string(list_filter(list_transform([x FOR x, i IN l IF list_position(l, x) = i], lambda t: ltrim(trim(t), '#')), lambda t: trim(t) <> '')[:10], '|') AS topics
FROM (SELECT p_partkey, list_concat(['##' || p_name, p_type, ' ', '#' || p_type, '##' || p_name, ' #'], [p_brand || '-' || k FOR k IN range(p_partkey % 12)]) AS l FROM part)
""")
def published_topics(m: Model) -> DataFrame:
    more = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.when(k < F.col("p_partkey") % 12, F.concat_ws("-", "p_brand", k)))
    raw = F.concat(F.array(F.concat(F.lit("##"), "p_name"), F.col("p_type"), F.lit(" "), F.concat(F.lit("#"), "p_type"), F.concat(F.lit("##"), "p_name"), F.lit(" #")), F.filter(more, F.isnotnull))
    return _parts(m, topics=F.array_join(text.clean_topics(raw), "|"))


@query("SELECT p_partkey AS id, left(trim(regexp_replace(p_name || ' & ' || p_type || chr(10) || '<b> ' || repeat('x', p_partkey % 600), '\\s+', ' ', 'g')), 500) AS clean FROM part")
def text_clean(m: Model) -> DataFrame:
    raw = F.concat(F.lit("  "), "p_name", F.lit(" &amp; \0"), "p_type", F.lit("\n&lt;b&gt;\t "), F.repeat(F.lit("x"), (F.col("p_partkey") % 600).cast("int")), F.lit(" "))
    return _parts(m, clean=text.clean_text(raw))


@query("""
SELECT p_partkey AS id, CASE p_partkey % 10 WHEN 0 THEN 'topic-' || unicode('图') WHEN 1 THEN 'topic-' || (31 * unicode('图') + unicode('片')) ELSE replace(p_name, ' ', '-') || '-' || lower(replace(p_brand, '#', '-')) END AS topic,
  p_type || '-' || CASE WHEN p_partkey % 10 < 2 THEN 'key-' || substr(sha1(CASE p_partkey % 10 WHEN 0 THEN '图' ELSE '图片' END), 1, 16) ELSE replace(p_name, ' ', '-') || '-' || lower(replace(p_brand, '#', '-')) END AS tag FROM part
""")
def topic_and_tag_slugs(m: Model) -> DataFrame:
    name = F.when(F.col("p_partkey") % 10 == 0, "图").when(F.col("p_partkey") % 10 == 1, "图片").otherwise(F.concat_ws(" ", "p_name", "p_brand"))
    return _parts(m, topic=text.topic_slug(name), tag=text.tag_slug(F.col("p_type"), name))


@query("""
SELECT p_partkey AS id, CASE WHEN trim(coalesce(title, '')) = '' OR length(title) > 12 THEN 'title' WHEN trim(coalesce(content, '')) = '' OR length(content) > 9 THEN 'content' END AS fault
FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN ' ' ELSE p_name END AS title, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand || repeat('x', p_partkey % 3) END AS content FROM part)
""")
def request_faults(m: Model) -> DataFrame:
    rows = _parts(m, title=F.when(F.col("p_partkey") % 7 == 0, " ").otherwise(F.col("p_name")), content=F.when(F.col("p_partkey") % 11 > 0, F.concat("p_brand", F.repeat(F.lit("x"), (F.col("p_partkey") % 3).cast("int")))))
    return events.checked(rows, {"title": 12, "content": 9}).select("id", "fault")


@query("""
SELECT user_id, arg_max(nullif(trim(n), ''), id) FILTER (nullif(trim(n), '') IS NOT NULL) AS nickname, arg_max(trim(b), id) FILTER (b IS NOT NULL) AS bio
FROM (SELECT id, user_id, CASE kind WHEN 'LIKE' THEN ' n' || id || ' ' WHEN 'SHARE' THEN ' ' END AS n, CASE WHEN kind IN ('SHARE', 'FAVORITE') THEN ' b ' || id END AS b FROM behaviors) GROUP BY 1
""")
def profile_updates(m: Model) -> DataFrame:
    number = lambda head: F.concat(F.lit(head), F.col("id").cast("string"), F.lit(" "))
    nickname = F.when(F.col("kind") == "LIKE", number(" n")).when(F.col("kind") == "SHARE", " ")
    changes = m.behaviors().select("id", F.col("id").alias("ts"), "user_id", nickname.alias("nickname"), F.when(F.col("kind").isin("SHARE", "FAVORITE"), number(" b ")).alias("bio"), F.lit(None).cast("string").alias("avatar"))
    return events.profiles(events.cleaned_profiles(changes), ["nickname", "bio"])


@query("SELECT p_partkey AS id, strftime(CASE WHEN p_partkey % 4 = 0 THEN TIMESTAMP '2024-03-01 10:00:00' ELSE TIMESTAMP '2024-01-01 00:00:00' END, '%Y-%m-%d %H:%M') AS published_at FROM part")
def write_clock(m: Model) -> DataFrame:
    rows = _parts(m, published_at=F.when(F.col("p_partkey") % 4 > 0, F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))))
    return events.with_clock(rows, "published_at", "2024-03-01 10:00:00").select("id", F.date_format("published_at", "yyyy-MM-dd HH:mm").alias("published_at"))


@query("SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'unknown' ELSE event_type END AS kind, CASE WHEN event_id % 2 = 0 THEN 'unknown' ELSE 'feed' END AS scene FROM events")
def behavior_defaults(m: Model) -> DataFrame:
    raw = m.table("events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("kind"), F.when(F.col("event_id") % 2 == 0, " ").otherwise("feed").alias("scene"))
    return events.behavior_rows(raw)


# files

_FILES = ("A.JPG", "b.jpeg", "c.PNG", "d.bmp", "e", "f.tiff", "g.webp", "h.gif")
_TYPES = ("image/png", "image/gif", "image/webp", "text/html", "image/jpeg; q=1")


@query(f"""
SELECT id, CASE WHEN e IN ('.jpg', '.jpeg', '.png', '.gif', '.webp') THEN e ELSE CASE t WHEN 'image/png' THEN '.png' WHEN 'image/gif' THEN '.gif' WHEN 'image/webp' THEN '.webp' ELSE '.jpg' END END AS uploaded,
  CASE WHEN e = '.jpeg' THEN '.jpg' WHEN e IN ('.jpg', '.png', '.gif', '.webp', '.bmp') THEN e ELSE CASE t WHEN 'image/png' THEN '.png' WHEN 'image/gif' THEN '.gif' WHEN 'image/webp' THEN '.webp' ELSE '.jpg' END END AS imported,
  CASE t WHEN 'image/png' THEN '.png' WHEN 'image/gif' THEN '.gif' WHEN 'image/webp' THEN '.webp' WHEN 'image/jpeg; q=1' THEN '.jpg' ELSE '.bin' END AS downloaded,
  CASE e WHEN '.png' THEN 'image/png' WHEN '.gif' THEN 'image/gif' WHEN '.webp' THEN 'image/webp' ELSE 'image/jpeg' END AS served,
  CASE e WHEN '.jpg' THEN 'image/jpeg' WHEN '.jpeg' THEN 'image/jpeg' WHEN '.png' THEN 'image/png' WHEN '.gif' THEN 'image/gif' WHEN '.webp' THEN 'image/webp' WHEN '.bmp' THEN 'image/bmp' ELSE 'application/octet-stream' END AS guessed
FROM (SELECT p_partkey AS id, lower(regexp_extract({_listed('p_partkey', *_FILES)}, '\\.[A-Za-z0-9]+$')) AS e, {_listed('p_partkey // 8', *_TYPES)} AS t FROM part)
""")
def file_endings(m: Model) -> DataFrame:
    rows = _parts(m, name=_pick("p_partkey", *_FILES), eighth=F.floor(F.col("p_partkey") / 8)).withColumn("t", _pick("eighth", *_TYPES))
    name, kind = F.col("name"), F.col("t")
    return rows.select(
        "id", media.upload_ending(name, kind).alias("uploaded"), media.import_ending(name, kind).alias("imported"), media.download_ending(kind, F.lit(".bin")).alias("downloaded"), media.object_content_type(name).alias("served"), media.content_type(name).alias("guessed")
    )


_KEYS = ("/a/b.png", "a\\b.jpg", "..", " ", None, "//x", "a/../b", "c.gif")


@query(f"""
SELECT p_partkey AS id, 'originals/' || strftime(DATE '2024-02-03' + CAST(p_partkey % 40 AS INTEGER), '%Y/%m/%d/') || substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 20) || '.png' AS made,
  CASE WHEN trim(k) <> '' AND NOT contains(k, '..') THEN 'https://cdn.example.com/' || k END AS address
FROM (SELECT p_partkey, ltrim(replace({_listed('p_partkey', *_KEYS)}, '\\', '/'), '/') AS k FROM part)
""")
def object_keys(m: Model) -> DataFrame:
    day = F.date_add(F.to_date(F.lit("2024-02-03")), (F.col("p_partkey") % 40).cast("int"))
    made = media.object_key(day, F.sha2(F.col("p_partkey").cast("string"), 256), F.lit(".png"))
    return _parts(m, made=made, address=media.public_url("https://cdn.example.com/", media.safe_key(_pick("p_partkey", *_KEYS))))


_NAMES = ("red ring.final.png", " x .jpg", ".hidden", "plain", "  .gif")


@query(f"SELECT p_partkey AS id, left(CASE WHEN trim(stem) = '' THEN n ELSE trim(stem) END, 160) AS title FROM (SELECT p_partkey, n, CASE WHEN n LIKE '.%' THEN n ELSE regexp_replace(n, '\\.[^.]*$', '') END AS stem FROM (SELECT p_partkey, {_listed('p_partkey', *_NAMES)} || CASE WHEN p_partkey % 5 = 3 THEN repeat('z', p_partkey % 200) ELSE '' END AS n FROM part))")
def file_titles(m: Model) -> DataFrame:
    name = F.concat(_pick("p_partkey", *_NAMES), F.when(F.col("p_partkey") % 5 == 3, F.repeat(F.lit("z"), (F.col("p_partkey") % 200).cast("int"))).otherwise(""))
    return _parts(m, title=media.title_of(name))


_ADDRESSES = ("u", "", None)


@query(f"""
SELECT id, coalesce(nullif(a, ''), nullif(b, ''), nullif(c, ''), 'none') AS address
FROM (SELECT p_partkey AS id, {_listed('p_partkey', *_ADDRESSES)} AS a, {_listed('p_partkey // 3', 'v', '', None)} AS b, {_listed('p_partkey // 9', None, 'w')} AS c FROM part)
""")
def address_chain(m: Model) -> DataFrame:
    rows = m.table("part").select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 3).alias("x"), F.floor(F.col("p_partkey") / 9).alias("y"))
    return rows.select("id", urls.first_address(_pick("id", *_ADDRESSES), _pick("x", "v", "", None), _pick("y", None, "w"), F.lit("none")).alias("address"))


@query("""
SELECT sha256(text) AS hash, CAST(strlen(text) AS BIGINT) AS bytes, 'd/' || doc_id || '.PNG' AS path FROM documents WHERE doc_id % 3 > 0 AND text IS NOT NULL ORDER BY path LIMIT 50
""")
def image_files(m: Model) -> DataFrame:
    ending = F.when(F.col("doc_id") % 3 > 0, ".PNG").otherwise(".txt")
    listed = m.corpus().filter("text is not null").select(F.concat(F.lit("d/"), "doc_id", ending).alias("path"), F.to_binary("text", F.lit("utf-8")).alias("content"))
    return files.image_rows(listed, head=50).select("hash", "bytes", "path")


# lines and logs

@query("""
SELECT page_id AS id, max_by(path, seq) AS path, min(seq) AS first_seq FROM (SELECT page_id // 3 AS page_id, page_id AS seq, 'p' || page_id AS path FROM pages WHERE page_id % 4 > 0 AND page_id % 5 > 0) GROUP BY 1
""")
def good_jobs(m: Model) -> DataFrame:
    ok, path = F.col("page_id") % 4 > 0, F.when(F.col("page_id") % 5 > 0, F.concat(F.lit("p"), F.col("page_id")))
    line = F.to_json(F.struct(F.floor(F.col("page_id") / 3).alias("id"), F.col("page_id").alias("seq"), ok.alias("ok"), path.alias("path")))
    rows = files.parse_jsonl(m.table("pages").select(line.alias("line")), "line", "id long, seq long, ok boolean, path string", strict=True)
    return curation.latest_jobs(rows)


@query("SELECT DISTINCT sha1('img.example.com/originals/' || (page_id % 40) || '/ab/p.jpg') AS key FROM pages WHERE page_id % 5 > 0 AND page_id % 3 > 0")
def finished_keys(m: Model) -> DataFrame:
    url = F.concat(F.lit("https://IMG.example.com/236x/"), F.col("page_id") % 40, F.lit("/ab/P.jpg"))
    line = F.when(F.col("page_id") % 5 == 0, '{"ok": tr').otherwise(F.to_json(F.struct((F.col("page_id") % 3 > 0).alias("ok"), url.alias("image_url"))))
    return curation.completed_keys(files.parse_jsonl(m.table("pages").select(line.alias("line")), "line", "ok boolean, image_url string", strict=False), HOST)


@query("SELECT url, min(place) AS place FROM (SELECT CASE page_id % 5 WHEN 0 THEN 'https://h' || page_id % 20 || '.example.com/' WHEN 1 THEN 'http://x.com/a?q=' || page_id % 7 ELSE 'https://y.com/p' END AS url, page_id AS place FROM pages WHERE page_id % 5 < 3) GROUP BY 1")
def start_urls(m: Model) -> DataFrame:
    number = lambda n: (F.col("page_id") % n).cast("string")
    kinds = [F.concat(F.lit("  h"), number(20), F.lit(".example.com#top ")), F.concat(F.lit("HTTP://x.com/a;v=1?q="), number(7)), F.lit("//y.com/p?"), F.lit("ftp://no.com/"), F.lit("  ")]
    line = F.element_at(F.array(*kinds), (F.col("page_id") % 5 + 1).cast("int"))
    return files.distinct_urls(m.table("pages").select(line.alias("line"), F.col("page_id").alias("place")), "line")


# addresses and pages

_DETAILS = ("https://www.img.example.com/pin/{}/x?y", "http://img.example.com/PIN/{}", "https://other.com/pin/{}/", "https://img.example.com/pin/no/", "")


@query("SELECT page_id, CASE WHEN page_id % 5 < 2 THEN 'https://www.img.example.com/pin/' || page_id || '/' ELSE '' END AS detail FROM pages")
def detail_urls(m: Model) -> DataFrame:
    raw = F.replace(_pick("page_id", *_DETAILS), F.lit("{}"), F.col("page_id").cast("string"))
    return m.table("pages").select("page_id", urls.detail_url(urls.normalize_url(raw), HOST, "pin").alias("detail"))


@query("SELECT page_id, 'https://h.com/a' || page_id || '.jpg|https://img.example.com/474x/b.png|https://h.com/c d.gif' AS found FROM pages")
def srcset_parse(m: Model) -> DataFrame:
    raw = F.concat(F.lit("https:\\/\\/h.com/a"), F.col("page_id"), F.lit(".jpg;x 1x, //img.example.com/474x/b.png 2x ,, data:x 3x, /c%20d.gif#e"))
    return m.table("pages").select("page_id", F.array_join(urls.normalized_srcset(raw, F.lit("https://h.com/p/q")), "|").alias("found"))


@query("""
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://img.example.com/originals/1/2/p.jpg|https://img.example.com/736x/1/2/p.jpg|https://img.example.com/236x/1/2/p.jpg|https://img.example.com/x/y.gif'
  WHEN 1 THEN 'https://h.com/b.png|https://h.com/a.png|https://h.com/c.gif' ELSE '' END AS ranked FROM pages
""")
def url_ranking(m: Model) -> DataFrame:
    own = F.array(*map(F.lit, ("https://img.example.com/x/y.gif", "https://img.example.com/236x/1/2/p.jpg", "https://img.example.com/736x/1/2/p.jpg", "https://img.example.com/236x/1/2/p.jpg")))
    other = F.array(*map(F.lit, ("https://h.com/b.png", "https://h.com/c.gif", "https://h.com/a.png")))
    listed = F.when(F.col("page_id") % 3 == 0, own).when(F.col("page_id") % 3 == 1, other).otherwise(F.array().cast("array<string>"))
    return m.table("pages").select("page_id", F.array_join(urls.ranked_urls(urls.with_originals(listed, HOST)), "|").alias("ranked"))


_IMAGES = ("https://img.example.com/75x75_RS/a.jpg", "https://img.example.com/736x/a/b.jpg", "https://img.example.com/avatars/b.png", "https://img.example.com/x/y.svg", "https://o.com/a.PNG?x", "ftp://img.example.com/a.jpg", "https://notimg.example.com/736x/a/b.jpg", "https://img.example.com:443/736x/a/b.jpg")


@query("SELECT page_id, page_id % 8 IN (1, 7) AS own, page_id % 8 NOT IN (3, 5) AS any_host, page_id % 8 IN (0, 2) AS small FROM pages")
def allowed_images(m: Model) -> DataFrame:
    url = _pick("page_id", *_IMAGES)
    return m.table("pages").select("page_id", urls.allowed_image(url, HOST).alias("own"), urls.allowed_image(url).alias("any_host"), urls.small_asset(url).alias("small"))


@query("""
SELECT page_id, 'http://a.b/c d?x=1&y=' || page_id AS escaped, 'https://h.com/p/x/' || page_id AS joined, 'https://c.d/e' AS bare, '' AS none FROM pages
""")
def url_escapes(m: Model) -> DataFrame:
    """Entities, percent codes, escaped slashes, parameters, fragments, relative addresses and marks at the end."""
    number = F.col("page_id").cast("string")
    return m.table("pages").select(
        "page_id",
        urls.normalize_url(F.concat(F.lit("'http:\\/\\/a.b\\u002Fc%20d;p?x=1&amp;y="), number, F.lit("#f'"))).alias("escaped"),
        urls.normalize_url(F.concat(F.lit("/p/x/"), number, F.lit(".,;]")), F.lit("https://h.com/y/z?q")).alias("joined"),
        urls.normalize_url(F.lit(' "//c.d/e;v=1" ')).alias("bare"),
        urls.normalize_url(F.lit("ftp://a.b/c")).alias("none"),
    )


@query("""
SELECT page_id, unnest(['https://h.com/a/c/' || page_id, 'https://h.com/d', 'https://o.com/e?f', 'https://h.com/a/b?g=' || page_id, 'https://h.com/x/y', 'https://h.com/z/']) AS target FROM pages
""")
def relative_links(m: Model) -> DataFrame:
    number = F.col("page_id").cast("string")
    href = F.array(F.concat(F.lit("c/"), number), F.lit("/d#top"), F.lit("//o.com/e?f"), F.concat(F.lit("?g="), number), F.lit("../x/./y"), F.lit("../../z/"), F.lit("mailto:a@b"), F.lit("#only"))
    rows = m.table("pages").select("page_id", F.explode(href).alias("href"))
    return rows.select("page_id", urls.resolved(F.col("href"), F.lit("https://h.com/a/b?q=1#f")).alias("target")).filter("target is not null")


@query("""
SELECT 'https://www.img.example.com/p' || page_id AS source, place, url, fallbacks, detail_url, alt, width, height FROM (
  SELECT page_id, CAST(0 AS INTEGER) AS place, 'https://img.example.com/originals/1/2/' || page_id || '.jpg' AS url, 'https://img.example.com/474x/1/2/' || page_id || '.jpg|https://img.example.com/236x/1/2/' || page_id || '.jpg' AS fallbacks,
    'https://www.img.example.com/pin/' || page_id || '/' AS detail_url, 'a & b' AS alt, CAST(640 AS BIGINT) AS width, CAST(-1 AS BIGINT) AS height FROM pages
  UNION ALL SELECT page_id, 2, 'https://img.example.com/x/' || page_id || '.png', '', '', '', -1, -1 FROM pages)
""")
def dom_candidates(m: Model) -> DataFrame:
    n = F.col("page_id").cast("string")
    html = F.concat(
        F.lit('<p><a href="/pin/'), n, F.lit('/?z"><b><img alt=" a &amp;  b" width="640.5" height="auto" src="//img.example.com/236x/1/2/'), n, F.lit('.jpg" srcset="https://img.example.com/474x/1/2/'), n,
        F.lit('.jpg 2x"></b></a><img src="https://img.example.com/75x75/s.jpg"><link rel="preload" as="image" href="https://img.example.com/x/'), n, F.lit('.png"><source src="q"><img src="https://o.com/a.jpg"></p>'),
    )
    pages = m.table("pages").select(F.concat(F.lit("https://www.img.example.com/p"), n).alias("url"), html.alias("html"))
    return curation.page_candidates(pages, HOST, "pin").withColumn("fallbacks", F.array_join("fallbacks", "|")).fillna(-1, ["width", "height"])


@query("SELECT count(DISTINCT page_id % 40) FILTER (page_id % 40 >= 10) AS added FROM pages")
def added_keys(m: Model) -> DataFrame:
    keys = m.table("pages").select((F.col("page_id") % 40).cast("string").alias("key"))
    return curation.new_keys(keys, m.spark.range(10).select(F.col("id").cast("string").alias("key")))


# vocabulary

_PATHS = "(SELECT DISTINCT p_type AS a, split_part(p_name, ' ', 1) AS b, split_part(p_name, ' ', 2) AS c FROM part)"


@query(f"""+
t AS (SELECT 2000 + row_number() OVER (ORDER BY a) AS id, a FROM (SELECT DISTINCT a FROM {_PATHS} WHERE a <> 'SMALL')),
known AS (SELECT id, a FROM t UNION ALL SELECT 2000, 'SMALL'),
n1 AS (SELECT DISTINCT known.id AS parent_id, a, b FROM {_PATHS} JOIN known USING (a)),
s AS (SELECT (SELECT max(id) FROM known) + row_number() OVER (ORDER BY parent_id, b) AS id, * FROM n1),
n2 AS (SELECT DISTINCT s.id AS parent_id, a, b, c FROM {_PATHS} JOIN s USING (a, b)),
l AS (SELECT (SELECT max(id) FROM s) + row_number() OVER (ORDER BY parent_id, c) AS id, * FROM n2)
SELECT id, a AS name, CAST(-1 AS BIGINT) AS parent_id, lower(a) AS slug, 0 AS sort_no FROM t
UNION ALL SELECT id, b, parent_id, lower(a) || '-' || b, 10 FROM s
UNION ALL SELECT id, c, parent_id, lower(a) || '-' || b || '-' || c, 20 FROM l
""")
def category_paths(m: Model) -> DataFrame:
    words = F.split("p_name", " ")
    paths = m.table("part").select(F.array(F.concat(F.lit(" #"), "p_type"), words[0], F.lit(" "), words[0], F.concat(F.lit("#"), words[1])).alias("path"))
    known = m.spark.createDataFrame([(2000, "SMALL", None, "small", 0), (1999, "small", None, "small", 0)], "id long, name string, parent_id long, slug string, sort_no int")
    return taxonomy.ensure_paths(known, paths).fillna(-1, ["parent_id"])


@query("""
SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN CAST(r_regionkey + 1000 AS BIGINT) WHEN 1 THEN CAST(n_nationkey AS BIGINT) ELSE -1 END AS category_id
FROM part JOIN nation ON n_nationkey = p_partkey % 25 JOIN region ON r_regionkey = n_regionkey
""")
def categories_of_paths(m: Model) -> DataFrame:
    names = m.table("nation").join(m.table("region"), F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    rows = m.table("part").join(names, F.col("p_partkey") % 25 == F.col("n_nationkey"))
    path = F.when(F.col("p_partkey") % 3 == 0, F.array(F.concat(F.lit("#"), "region"))).when(F.col("p_partkey") % 3 == 1, F.array("region", F.lit(" "), "nation")).otherwise(F.array("nation", "region"))
    return taxonomy.category_of_path(m.categories(), rows.select(F.col("p_partkey").alias("id"), path.alias("path"))).fillna(-1, ["category_id"])


@query("""
SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 4 = 0 THEN 7 ELSE 1 END AS category_id, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 > 0 THEN p_brand ELSE p_name END AS description FROM part
""")
def annotated_images(m: Model) -> DataFrame:
    images = _parts(m, category_id=F.lit(1), description=F.col("p_name"))
    found = _parts(m, category_id=F.when(F.col("p_partkey") % 4 == 0, 7), description=F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand")).otherwise("")).filter("id % 2 = 0")
    return taxonomy.annotated(images, found)
