"""Queries over texts: normalising, blocks, links, tags, shingles, tokens, keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..tables import spread, table
from .common import NOTES, notes


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def txt1_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and hashes of the three normalised forms of each document."""
    docs = _documents(spark, sf_dir)
    forms = {n: T.normalized(F.col("text"), link) for n, link in (("target", "target"), ("alias", "alias"), ("page", "page"))}
    return docs.select("doc_id", *[f(v).alias(f"{n}_{k}") for n, v in forms.items() for k, f in (("length", F.length), ("md5", F.md5))])


def txt5_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of each document with their snippets."""
    docs = _documents(spark, sf_dir)
    rows = docs.select("doc_id", F.posexplode(T.blocks(T.normalized(F.col("text")))).alias("block_index", "block"))
    return rows.select("doc_id", "block_index", T.snippet(F.col("block")).alias("snippet"), F.length("block").alias("block_length"))


def txt6_paragraph_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks at blank lines or sentence marks, of at least 8 characters, the first 80 of a document (the feature's limit)."""
    pieces = F.slice(T.blocks(T.normalized(F.col("text"), "target"), 8, r"\n\s*\n|[。！？!?；;]+"), 1, 80)
    return _documents(spark, sf_dir).select("doc_id", F.size(pieces).alias("blocks"), F.aggregate(pieces, F.lit(0), lambda a, b: a + F.length(b)).alias("characters"))


def txt7_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space collapsed before splitting, blocks cut at 180 characters, up to 8 numbers of each."""
    rows = _documents(spark, sf_dir).select("doc_id", F.posexplode(T.blocks(T.collapsed(T.normalized(F.col("text"))), 8, r"[。！？!?；;]+")).alias("block_index", "block"))
    return rows.select("doc_id", "block_index", T.snippet(F.col("block"), 180).alias("fragment"), F.array_join(F.slice(F.regexp_extract_all("block", F.lit(r"([0-9]+(?:\.[0-9]+)?)"), 1), 1, 8), "|").alias("numbers"))


def txt9_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return docs.select("doc_id", F.posexplode(T.wikilinks(F.col("text"))).alias("position", "link"))


def txt10_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each tag occurs: tags of the texts and of the notes' own lists."""
    docs = _documents(spark, sf_dir).select(F.explode(T.hashtags(F.col("text"))).alias("tag"))
    own = notes(spark, sf_dir).select(F.explode("tags").alias("tag"))
    return docs.unionAll(own).groupBy("tag").count().withColumnRenamed("count", "uses")


def txt11_all_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many notes have each shingle of Han characters."""
    rows = notes(spark, sf_dir).select("note_id", F.explode(F.array_distinct(T.cjk_shingles(F.col("text")))).alias("shingle"))
    return rows.groupBy("shingle").agg(F.count("*").alias("notes"))


def txt11_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many notes have each shingle of Han characters, of those in at least ten. txt11_all_shingles has every one."""
    return txt11_all_shingles(spark, sf_dir).where("notes >= 10")


def txt13_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of each Latin word of three letters and more, and of each run of Han characters, over all documents."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z]{3,}|[\x{4e00}-\x{9fff}]{2,})"), 1)
    return _documents(spark, sf_dir).select(F.explode(found).alias("token")).groupBy("token").agg(F.count("*").alias("occurrences"))


def txt16_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, folder and day in the name of each file."""
    f = table(spark, sf_dir, "files").select("path").distinct()
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return f.select(
        "path",
        F.lower(F.regexp_replace(stem, T.SPACE, "")).alias("title_key"),
        F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise(".").alias("folder"),
        F.expr("try_to_date(nullif(regexp_extract(path, '(20[0-9]{2}-[0-9]{2}-[0-9]{2})', 1), ''), 'yyyy-MM-dd')").alias("named_day"),
    )


def vec4_fnv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32-bit FNV-1a of each distinct file title."""
    return table(spark, sf_dir, "files").select("title").distinct().select("title", T.fnv1a(F.col("title")).alias("hash"))


_SP = r"[\s\p{Z}]+"


def _norm(link: str) -> str:
    t = r"regexp_replace(text, '(?s)\A---\n.*?\n---\n', '')"
    t = rf"regexp_replace({t}, '(?s)```.*?```', '', 'g')"
    t = rf"regexp_replace({t}, '!\[\[.*?\]\]', '', 'g')"
    if link == "alias":
        t = rf"regexp_replace({t}, '\[\[[^\]|]+\|([^\]]+)\]\]', '\1', 'g')"
        t = rf"regexp_replace({t}, '\[\[([^\]|]+)\]\]', '\1', 'g')"
    elif link == "page":
        t = rf"regexp_replace({t}, '\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]', '\1', 'g')"
    else:
        t = rf"regexp_replace({t}, '\[\[([^\]|]+)(?:\|[^\]]+)?\]\]', '\1', 'g')"
    t = rf"regexp_replace({t}, 'https?://\S+', '', 'g')"
    return _col(t) if link in ("alias", "page") else t


def _col(t: str) -> str:
    return rf"trim(regexp_replace({t}, '{_SP}', ' ', 'g'), ' ')"


def blocks_sql(text: str, least: int = 4, marks: str = r"[\n。！？!?；;]+") -> str:
    return rf"list_filter(list_transform(regexp_split_to_array({text}, '{marks}'), lambda b: trim(regexp_replace(b, '{_SP}', ' ', 'g'), ' -' || chr(9))), lambda b: length(b) >= {least})"


def snippet_sql(t: str, limit: int = 96) -> str:
    return f"case when length({_col(t)}) <= {limit} then {_col(t)} else left({_col(t)}, {limit - 1}) || '…' end"


_SHINGLES = """flatten(list_transform(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]{2,}'), lambda r: list_concat(case when length(r) <= 4 then [r] else [] end,
  list_concat(list_transform(range(1, length(r)), lambda i: substring(r, i, 2)), list_transform(range(1, greatest(length(r) - 1, 1)), lambda i: substring(r, i, 3))))))"""

QUERIES = {
    "txt1_normalize": txt1_normalize, "txt5_blocks": txt5_blocks, "txt6_paragraph_blocks": txt6_paragraph_blocks, "txt7_fragments": txt7_fragments, "txt9_links": txt9_links, "txt10_tags": txt10_tags,
    "txt11_shingles": txt11_shingles, "txt11_all_shingles": txt11_all_shingles, "txt13_tokens": txt13_tokens, "txt16_titles": txt16_titles, "vec4_fnv": vec4_fnv,
}
ORACLE = {
    "txt1_normalize": "select doc_id, " + ", ".join(f"length({_norm(k)}) as {k}_length, md5({_norm(k)}) as {k}_md5" for k in ("target", "alias", "page")) + " from documents",
    "txt5_blocks": f"select doc_id, (i - 1)::int as block_index, {snippet_sql('b')} as snippet, length(b)::int as block_length from (select doc_id, unnest(x) as b, generate_subscripts(x, 1) as i from (select doc_id, {blocks_sql(_norm('target'))} as x from documents))",
    "txt6_paragraph_blocks": f"select doc_id, len(x)::int as blocks, coalesce(list_sum(list_transform(x, lambda b: length(b))), 0)::int as characters from (select doc_id, list_slice({blocks_sql(_norm('target'), 8, chr(92) + 'n' + chr(92) + 's*' + chr(92) + 'n|[。！？!?；;]+')}, 1, 80) as x from documents)",
    "txt7_fragments": f"select doc_id, (i - 1)::int as block_index, {snippet_sql('b', 180)} as fragment, array_to_string(list_slice(regexp_extract_all(b, '[0-9]+(?:\\.[0-9]+)?'), 1, 8), '|') as numbers from (select doc_id, unnest(x) as b, generate_subscripts(x, 1) as i from (select doc_id, {blocks_sql(_col(_norm('target')), 8, '[。！？!?；;]+')} as x from documents))",
    "txt9_links": r"""with l as (select doc_id, unnest(x) as link, generate_subscripts(x, 1) as i from (select doc_id, list_transform(regexp_extract_all(text, '\[\[([^\]|#]+)(?:[^\]]*)\]\]', 1), lambda t: trim(t, ' ')) as x from documents)),
f as (select doc_id, link, min(i) as i from l where link <> '' group by 1, 2) select doc_id, (row_number() over (partition by doc_id order by i) - 1)::int as position, link from f""",
    "txt10_tags": rf"""with {NOTES} select tag, count(*)::bigint as uses from (
select unnest(list_distinct(regexp_extract_all(text, '(?:^|\s)#([\p{{L}}_][\p{{L}}\p{{N}}_/\-]*)', 1))) as tag from documents union all select unnest(tags) from notes) group by 1""",
    "txt11_shingles": f"with {NOTES} select shingle, count(*)::bigint as notes from (select note_id, unnest(list_distinct({_SHINGLES})) as shingle from notes) group by 1 having count(*) >= 10",
    "txt11_all_shingles": f"with {NOTES} select shingle, count(*)::bigint as notes from (select note_id, unnest(list_distinct({_SHINGLES})) as shingle from notes) group by 1",
    "txt13_tokens": r"select token, count(*)::bigint as occurrences from (select unnest(regexp_extract_all(lower(text), '[a-z]{3,}|[\x{4e00}-\x{9fff}]{2,}')) as token from documents) group by 1",
    "txt16_titles": rf"""select distinct path, lower(regexp_replace(regexp_replace(regexp_replace(path, '^.*/', ''), '\.[^.]*$', ''), '{_SP}', '', 'g')) as title_key,
case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '.' end as folder, try_cast(nullif(regexp_extract(path, '(20[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}})', 1), '') as date) as named_day from files""",
    "vec4_fnv": "select title, list_reduce(list_transform(string_split(title, ''), lambda c: unicode(c)::bigint), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::bigint) as hash from (select distinct title from files)",
}
