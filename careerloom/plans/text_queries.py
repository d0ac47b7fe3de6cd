"""Scans, text expressions and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import norm as N
from ..functions import text as T
from ..functions import titles
from ..sources import tables as S
from .registry import query

STOPS = ", ".join(f"'{w}'" for w in sorted(set(T.STOP_WORDS)))
#: DuckDB: the words of a text, as functions.text.words has them.
ALL_WORDS = r"list_filter(regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z][a-z]+'))"
WORDS = f"list_filter({ALL_WORDS}, lambda x: not list_contains([{STOPS}], x))"


@query("select doc_id, lang as function, source as level, n_chars from documents where source in ('src0', 'src1', 'src2')")
def scan_filter_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.read(spark, sf_dir, "documents")
    return S.pruned(docs, ["doc_id", "lang", "source", "n_chars"], F.col("source").isin("src0", "src1", "src2")).select("doc_id", F.col("lang").alias("function"), F.col("source").alias("level"), "n_chars")


@query("select l_orderkey, l_extendedprice from lineitem where l_shipdate >= timestamp '2000-01-01' and l_discount between 0.05 and 0.07")
def parquet_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = S.read(spark, sf_dir, "lineitem")
    return S.pruned(line, ["l_orderkey", "l_extendedprice"], (F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp")) & F.col("l_discount").between(0.05, 0.07))


_LEVEL = "case l_linenumber when 1 then 'Intern' when 2 then 'ENTRY' when 3 then null when 4 then 'senior' else 'staff' end"
_COUNTRY = "case l_returnflag when 'N' then 'us' when 'A' then 'DE' end"


@query(f"select l_orderkey || '-' || l_linenumber as id, l_returnflag || l_linestatus as function, {_LEVEL} as level, {_COUNTRY} as country_code from lineitem where lower(l_returnflag || l_linestatus) = 'no' and lower(coalesce({_LEVEL}, '')) in ('intern', 'entry', 'junior', '') and upper(coalesce({_COUNTRY}, '')) in ('US', '')")
def clustered_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry-level postings of a function, from a corpus that is written in the order of what is asked for."""
    lines = S.read(spark, sf_dir, "lineitem")
    postings = lines.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.concat("l_returnflag", "l_linestatus").alias("function"), F.expr(_LEVEL).alias("level"), F.expr(_COUNTRY).alias("country_code"))
    path = S.shared_path(spark, "clustered-postings")
    S.write_clustered(postings, path)
    return S.clustered_entry_postings(spark, path, ["No"])


@query(
    """select cast(doc_id as varchar) as id, lang as function, source as level from documents
    union all select 'part-' || p_partkey, lower(p_type), 'entry' from part
    union all select * from (values ('lit-1', 'finance', 'intern'), ('lit-2', 'sales', 'entry'), ('lit-3', 'ops', null))"""
)
def source_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("function"), F.col("source").alias("level"))
    parts = S.read(spark, sf_dir, "part").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("id"), F.lower("p_type").alias("function"), F.lit("entry").alias("level"))
    literal = spark.createDataFrame([("lit-1", "finance", "intern"), ("lit-2", "sales", "entry"), ("lit-3", "ops", None)], "id string, function string, level string")
    return S.union_all(docs, parts, literal)


_FALLBACK = ", ".join(f"('{a}', '{b}')" for a, b in (("MACHINERY", "it"), ("BUILDING", "fr"), ("AUTOMOBILE", "xx"), ("fr", "de")))


@query(
    f"""with fallback(src, dst) as (values {_FALLBACK}), have as (select distinct lang from documents),
    wanted as (select c_custkey, case when c_custkey % 3 = 0 then 'en' when c_custkey % 3 = 1 then c_mktsegment else 'fr' end as wanted from customer)
    select c_custkey, wanted, coalesce(a.lang, b.lang) as resolved from wanted left join have a on a.lang = wanted
    left join fallback on src = wanted left join have b on b.lang = dst"""
)
def partition_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.when(F.col("c_custkey") % 3 == 0, "en").when(F.col("c_custkey") % 3 == 1, F.col("c_mktsegment")).otherwise("fr")
    people = S.read(spark, sf_dir, "customer").select("c_custkey", wanted.alias("wanted"))
    fallback = spark.createDataFrame([("MACHINERY", "it"), ("BUILDING", "fr"), ("AUTOMOBILE", "xx"), ("fr", "de")], "src string, dst string")
    return S.resolve_partition(people, "wanted", S.read(spark, sf_dir, "documents"), "lang", fallback)


@query(
    """select p_partkey, regexp_replace(lower(p_brand || ' / ' || p_name || '-' || p_type), '[- ,/]', '', 'g') as market_key,
    regexp_replace(p_brand || ' ' || p_name || '-' || p_type, '[- ]', '', 'g') as vocabulary_key from part"""
)
def skill_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = S.read(spark, sf_dir, "part")
    return part.select("p_partkey", T.skill_key(F.concat_ws("", "p_brand", F.lit(" / "), "p_name", F.lit("-"), "p_type")).alias("market_key"), T.vocabulary_key(F.concat_ws("", "p_brand", F.lit(" "), "p_name", F.lit("-"), "p_type")).alias("vocabulary_key"))


@query(
    r"""select item_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z\s]', ' ', 'g'), '\s+', ' ', 'g')) as words,
    trim(regexp_replace(regexp_replace(lower(text), '[^a-z\s-]', ' ', 'g'), '\s+', ' ', 'g')) as hyphened from benchmark"""
)
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read(spark, sf_dir, "benchmark").select("item_id", T.letters_only(F.col("text")).alias("words"), T.letters_only(F.col("text"), True).alias("hyphened"))


@query(
    r"""select c_custkey, trim(regexp_replace(lower(replace(replace('  ' || c_name || chr(160) || 'Â ' || c_mktsegment, chr(160), ' '), 'Â', '')), '\s+', ' ', 'g')) as name,
    lower(trim('  ' || c_name || '@Example.ORG ')) as mail from customer"""
)
def name_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("  "), "c_name", F.lit(" Â "), "c_mktsegment")
    return S.read(spark, sf_dir, "customer").select("c_custkey", T.person_name(raw).alias("name"), T.email(F.concat(F.lit("  "), "c_name", F.lit("@Example.ORG "))).alias("mail"))


@query(
    r"""select s_suppkey, trim(regexp_replace(lower('#' || s_name || ' (' || s_nationkey || ')!'), '[^a-z0-9]+', '_', 'g'), '_') as slug,
    substr(regexp_replace(regexp_replace(s_name || ': a / b', '[^\w\s-]', '', 'g'), '\s+', '_', 'g'), 1, 60) as file,
    case when length(s_name) > 12 then substr(s_name, 1, 12) || '…' else s_name end as short from supplier"""
)
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("s_name")
    return S.read(spark, sf_dir, "supplier").select("s_suppkey", T.slug(F.concat(F.lit("#"), name, F.lit(" ("), F.col("s_nationkey").cast("string"), F.lit(")!"))).alias("slug"), T.safe_filename(F.concat(name, F.lit(": a / b"))).alias("file"), T.truncated(name, 12).alias("short"))


@query(f"select lang, token, count(*) as docs, cast(sum(c) as bigint) as uses from (select doc_id, lang, token, count(*) as c from (select doc_id, lang, unnest({WORDS.format(t='text')}) as token from documents) group by all) group by all")
def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = S.read(spark, sf_dir, "documents").select("doc_id", "lang", F.explode(T.words(F.col("text"))).alias("token"))
    return tokens.groupBy("doc_id", "lang", "token").agg(F.count("*").alias("c")).groupBy("lang", "token").agg(F.count("*").alias("docs"), F.sum("c").alias("uses"))


@query(
    rf"""with w as (select conv_id, turn, {ALL_WORDS.format(t='text')} as w from conversations),
    g as (select conv_id, turn, w, unnest(range(len(w))) as pos from w)
    select conv_id, turn, cast(pos as integer) as pos, n, array_to_string(w[pos + 1:pos + n], ' ') as gram from g, (values (1), (2), (3)) t(n) where pos + n <= len(w)"""
)
def ngrams_1_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.read(spark, sf_dir, "conversations").select("conv_id", "turn", T.words(F.col("text"), False).alias("w"))
    return rows.select("conv_id", "turn", F.explode(T.ngrams(F.col("w"))).alias("g")).select("conv_id", "turn", "g.pos", "g.n", "g.gram")


_TITLES = (
    "Software Developer", "Registered Nurse", "Sales Manager", "School Nurse Teacher", "Data Analyst", "Forest Ranger", "Civil Engineer", "Engineering Manager", "Engineers", "Cooking Instructor",
    "Cook, Short Order", "Line Cook", "Hostler", "Host and Hostess", "software tester", "IT Support Clerk", "Tax Preparer", "Truck Driver", "Machine Operator", "Court Reporter", "Fitness Coach",
    "Security Guard", "Child Care Worker", "Lab Technician", "Community Health Worker", "Astronaut",
)
_TITLE = f"case cast(p_partkey % {len(_TITLES)} as int) " + " ".join(f"when {k} then '{t}'" for k, t in enumerate(_TITLES)) + " end || case when p_size % 3 = 0 then ' (' || p_type || ')' else '' end"
#: What RE2 has in place of the rules' look-aheads.
_RE2 = {r"\bEngineer(?!$)": r"\bEngineer(?s:.)", r"\bCook(?!ing)": r"\bCook($|[^i]|i$|i[^n]|in$|in[^g])", r"\bHost(?!ler)": r"\bHost($|[^l]|l$|l[^e]|le$|le[^r])"}


def _title_sql(rules) -> str:
    cases = " ".join(f"when regexp_matches(title, '{_RE2.get(p, p)}') then '{f}'" for p, f in rules)
    return f"select p_partkey, title, case {cases} else 'unmapped' end as func from (select p_partkey, {_TITLE} as title from part)"


@query(_title_sql(titles.SIGNAL_RULES))
def title_rules_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles.titled(S.read(spark, sf_dir, "part").select("p_partkey", F.expr(_TITLE).alias("title")), "title")


@query(_title_sql(titles.OCCUPATION_RULES))
def occupation_title_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles.titled(S.read(spark, sf_dir, "part").select("p_partkey", F.expr(_TITLE).alias("title")), "title", rules=titles.OCCUPATION_RULES)


_CATEGORY = "case cast(p_partkey % 26 as int) " + " ".join(f"when {k} then '{c}'" for k, c in enumerate([*titles.CATEGORIES, "OTHER"])) + " end"


@query(f"with m(category, func) as (values {', '.join(str(kv) for kv in titles.CATEGORIES.items())}) select p_partkey, category, func from (select p_partkey, {_CATEGORY} as category from part) join m using (category)")
def category_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.read(spark, sf_dir, "part").select("p_partkey", F.expr(_CATEGORY).alias("category"))
    return rows.withColumn("func", titles.category_function(F.col("category"))).where("func is not null")


_ANSWERED = "case c_custkey % 9 when 0 then null when 1 then 'I forgot' when 2 then '  idk ' when 3 then 'Ann' when 4 then ' Not Sure ' when 5 then '   ' when 6 then 'unknown' when 7 then 'Bo L' else c_name end"
_NO_NAMES = ", ".join("'" + n.replace("'", "''") + "'" for n in T.NO_NAMES)


@query(f"select c_custkey, name, length(trim(coalesce(name, ''))) >= 4 and lower(trim(name)) not in ({_NO_NAMES}) as ok from (select c_custkey, {_ANSWERED} as name from customer)")
def valid_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read(spark, sf_dir, "customer").select("c_custkey", F.expr(_ANSWERED).alias("name")).withColumn("ok", T.valid_name(F.col("name")))


_ROLE = "case c_custkey % 5 when 0 then null when 1 then 'Mentee (Intern)' when 2 then 'Career INTERN ' || c_mktsegment when 3 then 'Mentor/CPC' else 'Champion' end"


@query(f"select c_custkey, coalesce(regexp_matches(lower(role), 'intern'), false) as intern from (select c_custkey, {_ROLE} as role from customer) where not coalesce(regexp_matches(lower(role), 'mentee|furniture'), false)")
def role_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = S.read(spark, sf_dir, "customer").select("c_custkey", F.expr(_ROLE).alias("role"))
    return people.where(T.holds_word(F.col("role"), ["mentee", "furniture"], negate=True)).select("c_custkey", T.holds_word(F.col("role"), ["intern"]).alias("intern"))


@query("select doc_id, cast(k as integer) as chunk, substr(text, k * 500 + 1, 500) as part from (select doc_id, text, unnest(range(greatest(cast(ceil(length(text) / 500.0) as bigint), 1))) as k from documents)")
def chunk_500(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read(spark, sf_dir, "documents").select("doc_id", F.explode(T.chunks(F.col("text"))).alias("c")).select("doc_id", "c.chunk", "c.part")


@query(
    """select doc_id, length(t) as n, md5(t) as digest from (select a.doc_id, case when coalesce(length(a.text), -1) >= coalesce(length(b.text), -1) then a.text else b.text end as t
    from documents a left join documents b on b.doc_id = a.doc_id + 1)"""
)
def longest_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.read(spark, sf_dir, "documents").select("doc_id", "text")
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("after"))
    return docs.join(after, "doc_id", "left").select("doc_id", N.longest_of(F.col("text"), F.col("after")).alias("t")).select("doc_id", F.char_length("t").cast("long").alias("n"), F.md5(F.col("t").cast("binary")).alias("digest"))


@query(
    """select o_orderkey, array_to_string(list_filter([case when o_orderstatus = 'F' then 'final' end, case when o_totalprice > 200000 then 'large' end, case when o_orderpriority < '3' then 'urgent' end], lambda x: x is not null), ', ') as tags from orders"""
)
def unpivot_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels from the names of the columns that are set, as a form exports its answers."""
    flags = {"Marks [final]": F.col("o_orderstatus") == "F", "Marks [large]": F.col("o_totalprice") > 200000, "Marks [urgent]": F.col("o_orderpriority") < "3"}
    return S.read(spark, sf_dir, "orders").select("o_orderkey", *[v.alias(k) for k, v in flags.items()]).select("o_orderkey", T.flag_labels(list(flags)).alias("tags"))


@query("select event_id, user_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read(spark, sf_dir, "events").select("event_id", "user_id", F.from_json("props", "k bigint")["k"].alias("k"))


_SPLIT = "n.n_name || '; ' || r.r_name || ' & b and  c And d,'"


@query(
    f"""select n_nationkey, cast(p.i as integer) as pos, trim(p.x) as part from (select n_nationkey, list_filter(string_split(regexp_replace({_SPLIT}, '(;|&| and | And )', ',', 'g'), ','), lambda x: trim(x) <> '') as l from nation n join region r on r_regionkey = n_regionkey) t,
    unnest(list_zip(range(len(l)), l)) u(z), (select z[1] as i, z[2] as x) p"""
)
def split_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = S.read(spark, sf_dir, "nation").join(S.read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    raw = F.concat("n_name", F.lit("; "), "r_name", F.lit(" & b and  c And d,"))
    return both.select("n_nationkey", F.posexplode(T.split_list(raw)).alias("pos", "part"))





@query(
    rf"""select conv_id, turn,
    case when length(trim(text)) = 0 then 0.0 when length(trim(text)) < 10 then 0.3 when length(trim(text)) <= 100 then 0.6 else 1.0 end::double as substance,
    least(len(list_distinct(list_filter(list_transform(regexp_split_to_array(lower(text), '[,\n]'), lambda x: trim(x)), lambda x: length(x) > 3))), 6) / 6.0::double as tags,
    case when regexp_full_match(lower(trim(text)), '\d+(\.\d+)?') or length(trim(text)) < 10 then 0.0 else round_even(({" + ".join("cast(" + " or ".join(f"contains(lower(text), '{s}')" for s in stems) + " as int)" for _, stems in N.COMPETENCES)}) / 6.0::double * 100, 1) end as coverage,
    case when regexp_full_match(lower(trim(text)), '\d+(\.\d+)?') or length(trim(text)) < 10 then 0 when h = 0 then 0 when h <= 1 then 33 when h <= 3 then 67 else 100 end as ladder,
    {" or ".join("contains(lower(text), '" + p + "')" for p in N.OPEN_PHRASES)} as open
    from (select *, {" + ".join(f"cast(contains(lower(text), '{s}') as int)" for s in N.RESUME_STEMS)} as h from conversations)"""
)
def text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return S.read(spark, sf_dir, "conversations").select("conv_id", "turn", N.substance(c).alias("substance"), N.tags(c).alias("tags"), N.competence_coverage(c).alias("coverage"), N.resume_steps(c).alias("ladder"), N.is_open(c).alias("open"))


@query(
    """with t as (select doc_id, lower(text) as x from documents)
    select doc_id, coalesce(regexp_extract(x, '[a-z0-9._%+-]+@[a-z0-9.-]+', 0), '') as mail, len(regexp_extract_all(x, '[a-z0-9._%+-]+@[a-z0-9.-]+')) as mails from t"""
)
def contact_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, p = F.lower("text"), "[a-z0-9._%+-]+@[a-z0-9.-]+"
    return S.read(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.regexp_extract(x, p, 0), F.lit("")).alias("mail"), F.size(F.regexp_extract_all(x, F.lit(p), 0)).cast("long").alias("mails"))
