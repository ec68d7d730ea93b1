"""Registered queries over the shared tables, one an operator, with their SQL.

``out`` names the result columns and their kinds: long, str, double (rounded to
six places on both sides).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions import text as T
from topicloom.functions.rng import token_hash_sql, uniform
from topicloom.operators import counts as C
from topicloom.operators import documents as D
from topicloom.operators import gibbs, likelihood, metrics, rotation, selection, trace, vocab
from topicloom.plans import online, runs
from topicloom.plans.params import FilterParams
from topicloom.sources import corpus as S
from topicloom.sources import thrift
from topicloom.sources.scratch import keep, scratch_path, spread
from topicloom.streaming import particle, reservoir

K, ALPHA, BETA, SEED = 4, 0.1, 0.1, 1
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
CASTS = {"long": "bigint", "str": "string", "double": "double"}


def query(out: str, sql: str | None = None):
    fields = [x.split(":") for x in out.split()]

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[(F.round(F.col(c).cast("double"), 6) + F.lit(0.0) if k == "double" else F.col(c).cast(CASTS[k])).alias(c) for c, k in fields])

        QUERIES[f.__name__] = run
        if sql:
            cols = ", ".join(f"round(CAST({c} AS DOUBLE), 6) + 0.0::DOUBLE AS {c}" if k == "double" else f"CAST({c} AS {'BIGINT' if k == 'long' else 'VARCHAR'}) AS {c}" for c, k in fields)
            head, _, body = sql.rpartition("\n--\n")
            SQL[f.__name__] = f"{'WITH ' + head if head else ''} SELECT {cols} FROM ({body}) AS result"
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, stop: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, category, tokens) of all documents; the language is the label."""
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return rows.select("doc_id", F.col("lang").alias("category"), T.prepared(F.col("text"), stop=stop).alias("tokens"))


def encoded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """(doc_id, category, pos, word_id) of all tokens, and the vocabulary's size."""
    docs = documents(spark, sf_dir)
    words = keep(vocab.build_vocab(docs), "vocab")
    return vocab.encode_tokens(docs, words, "category"), words.count()


def assigned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    tokens, size = encoded(spark, sf_dir)
    return C.initial_topics(tokens, K, SEED), size


def kept_documents(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """(doc_id, word_ids, topics) written, and the vocabulary's size: tokens stay in their documents."""
    docs = documents(spark, d)
    words = keep(vocab.build_vocab(docs), "vocab")
    return keep(D.initial_topics(vocab.encode_docs(docs, words), K, SEED), "assigned"), words.count()


# pieces of SQL

SPACE = r"[ \t\n\x0B\f\r]+"
NONEMPTY = "list_filter({}, lambda x: x <> '')"
ALPHA_TOKENS = NONEMPTY.format("regexp_split_to_array({}, '[^a-zA-Z]+')")
LOWER = "list_transform({}, lambda x: lower(x))"
STOP = "(" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")"
PREPARED = LOWER.format(ALPHA_TOKENS)
WITHOUT_STOP = "list_filter({}, lambda x: x NOT IN " + STOP + ")"
U = "CAST({} AS DOUBLE) / CAST(2147483647 AS DOUBLE)"
BASE = f"base AS (SELECT doc_id, lang AS category, {PREPARED.format('text')} AS tokens FROM documents)"
TOKENS = BASE + ",\ntoks AS (SELECT doc_id, category, unnest(tokens) AS word, generate_subscripts(tokens, 1) - 1 AS pos FROM base)"
VOCAB = TOKENS + """,
counted AS (SELECT word, count(*) AS n FROM toks GROUP BY word),
vocab AS (SELECT word, row_number() OVER (ORDER BY word) AS word_id, n FROM counted WHERE n > 1),
size AS (SELECT count(*) + 1 AS v FROM vocab)"""
ENCODED = VOCAB + ",\nenc AS (SELECT t.doc_id, t.category, t.pos, coalesce(v.word_id, 0) AS word_id FROM toks t LEFT JOIN vocab v ON t.word = v.word)"
ASSIGNED = ENCODED + f",\nasg AS (SELECT *, {token_hash_sql('doc_id', 'pos', 0, SEED)} % {K} AS topic FROM enc)"
COUNTS = ASSIGNED + """,
tw AS (SELECT topic, word_id, count(*) AS n FROM asg GROUP BY ALL),
tt AS (SELECT topic, count(*) AS n FROM asg GROUP BY ALL),
dt AS (SELECT doc_id, topic, count(*) AS n FROM asg GROUP BY ALL)"""
INFERRED = COUNTS + """,
inferred AS (SELECT doc_id, category, topic FROM (SELECT b.doc_id, b.category, coalesce(d.topic, 0) AS topic,
  row_number() OVER (PARTITION BY b.doc_id ORDER BY coalesce(d.n, 0) DESC, coalesce(d.topic, 0)) AS r FROM base b LEFT JOIN dt d ON b.doc_id = d.doc_id) WHERE r = 1)"""
GRID_TOPICS = f"(SELECT unnest(range({K})) AS k)"


def grid(leave_out: bool) -> str:
    own = "CASE WHEN a.topic = g.k THEN 1 ELSE 0 END" if leave_out else "0"
    one = 1 if leave_out else 0
    return f""",
nd AS (SELECT doc_id, count(*) AS n FROM asg GROUP BY doc_id),
grid AS (SELECT a.doc_id, a.pos, a.word_id, g.k, (coalesce(w.n, 0) - {own} + CAST({BETA} AS DOUBLE)) / (coalesce(t.n, 0) - {own} + CAST((SELECT v FROM size) * CAST({BETA} AS DOUBLE) AS DOUBLE))
  * ((coalesce(d.n, 0) - {own} + CAST({ALPHA} AS DOUBLE)) / (nd.n - {one} + CAST({K * ALPHA} AS DOUBLE))) AS p
  FROM asg a CROSS JOIN {GRID_TOPICS} g LEFT JOIN tw w ON w.topic = g.k AND w.word_id = a.word_id LEFT JOIN tt t ON t.topic = g.k
  LEFT JOIN dt d ON d.doc_id = a.doc_id AND d.topic = g.k JOIN nd ON nd.doc_id = a.doc_id)"""


def drawn(sweep: int) -> str:
    u = U.format(token_hash_sql("doc_id", "pos", sweep, SEED))
    return f""",
cum AS (SELECT *, sum(p) OVER (PARTITION BY doc_id, pos ORDER BY k) AS c, sum(p) OVER (PARTITION BY doc_id, pos) AS total FROM grid),
swept AS (SELECT doc_id, pos, word_id, coalesce(min(k) FILTER (WHERE c > {u} * total), {K - 1}) AS topic FROM cum GROUP BY doc_id, pos, word_id)"""


# text preparation


@query("doc_id:long n:long digest:str", f"SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {ALPHA_TOKENS.format('text')} AS t FROM documents)")
def tok_nonalpha(spark, d):
    return table(spark, d, "documents").select("doc_id", T.nonempty(T.nonalpha_tokens(F.col("text"))).alias("t")).select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("doc_id:long n:long digest:str", f"SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '{SPACE}'), lambda x: x <> '' AND NOT regexp_matches(x, '[^a-zA-Z]')) AS t FROM documents)")
def tok_whitespace(spark, d):
    return table(spark, d, "documents").select("doc_id", T.nonempty(T.whitespace_tokens(F.col("text"))).alias("t")).select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("doc_id:long n:long digest:str", f"SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {WITHOUT_STOP.format(PREPARED.format('text'))} AS t FROM documents)")
def lower_stop_filter(spark, d):
    return documents(spark, d, T.STOP_WORDS).select("doc_id", F.size("tokens").alias("n"), F.md5(F.array_join("tokens", " ")).alias("digest"))


@query("doc_id:long n:long digest:str", rf"SELECT doc_id, len(t) AS n, md5(array_to_string(t, chr(10))) AS digest FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(regexp_replace(x, '{SPACE}\z', ''), '{SPACE}')) AS t FROM documents)")
def wall_removal(spark, d):
    return table(spark, d, "documents").select("doc_id", T.without_walls(T.lines(F.col("text"))).alias("t")).select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", "\n")).alias("digest"))


@query("page_id:long n:long digest:str", rf"""SELECT page_id, CASE WHEN cut_at > 0 THEN len(l) - cut_at ELSE 0 END AS n, md5(CASE WHEN cut_at > 0 THEN array_to_string(l[cut_at + 1:], chr(10)) ELSE '' END) AS digest FROM (
  SELECT page_id, l, coalesce(list_position(list_transform(l, lambda x: trim(regexp_replace(x, '{SPACE}', ' ', 'g')) = ''), true), 0) AS cut_at FROM (SELECT page_id, string_split('Url: ' || url || chr(10) || chr(10) || html, chr(10)) AS l FROM pages))""")
def header_removal(spark, d):
    posts = table(spark, d, "pages").select("page_id", F.concat(F.lit("Url: "), "url", F.lit("\n\n"), "html").alias("text"))
    return posts.select("page_id", T.after_header(T.lines(F.col("text"))).alias("t")).select("page_id", F.size("t").alias("n"), F.md5(F.array_join("t", "\n")).alias("digest"))


@query("page_id:long paragraphs:long tokens:long digest:str", rf"""SELECT page_id, len(p) AS paragraphs, len(t) AS tokens, md5(array_to_string(t, ' ')) AS digest FROM (
  SELECT page_id, p, {PREPARED.format("regexp_replace(array_to_string(p, chr(10)), '<[^>]*>', ' ', 'g')")} AS t FROM (SELECT page_id, regexp_extract_all(html, '(?is)<p(?:\s[^>]*)?>(.*?)</p>', 1) AS p FROM pages))""")
def html_paragraph_text(spark, d):
    rows = table(spark, d, "pages").select("page_id", T.paragraphs(F.col("html")).alias("p"))
    rows = rows.select("page_id", "p", T.prepared(F.regexp_replace(F.array_join("p", "\n"), "<[^>]*>", " ")).alias("t"))
    return rows.select("page_id", F.size("p").alias("paragraphs"), F.size("t").alias("tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("doc_id:long category:str n:long digest:str", rf"""SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, category, len(t) AS n, md5(array_to_string(t, ' ')) AS digest FROM (
  SELECT doc_id, lang AS category, {WITHOUT_STOP.format(PREPARED.format(f"array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(regexp_replace(x, '{SPACE}" + chr(92) + f"z', ''), '{SPACE}')), chr(10))"))} AS t FROM documents) WHERE len(t) > 0""")
def newsgroup_transform(spark, d):
    posts = table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.col("lang").alias("category"), F.lit("train").alias("split"), "text")
    out = S.transform_newsgroups(posts, ["ord"], stop=T.STOP_WORDS, remove_header=False)
    return out.select("doc_id", "category", F.size("tokens").alias("n"), F.md5(F.array_join("tokens", " ")).alias("digest"))


@query("category:str split:str digest:str", "SELECT 'category=' || (item_id % 4) AS category, 'train' AS split, md5(text || chr(10)) AS digest FROM benchmark")
def newsgroup_tree(spark, d):
    """Posts as files in folders of categories, one a file."""
    path = scratch_path(spark, "tree")
    rows = table(spark, d, "benchmark").select((F.col("item_id") % 4).alias("category"), F.col("text").alias("value"))
    rows.write.option("maxRecordsPerFile", 1).partitionBy("category").text(path)
    return S.read_newsgroup_tree(spark, path, "train").select("category", "split", F.md5("text").alias("digest"))


@query("doc_id:long split:str n:long digest:str", rf"""SELECT doc_id, CASE WHEN {U.format(token_hash_sql('doc_id', '0', 0, SEED))} < 0.6 THEN 'train' ELSE 'test' END AS split, len(t) AS n, md5(array_to_string(t, ' ')) AS digest FROM (
  SELECT conv_id * 1000 + turn AS doc_id, list_filter(regexp_split_to_array(substr(text, instr(text, ' ') + 1), '{SPACE}'), lambda x: x <> '' AND NOT regexp_matches(x, '[^a-zA-Z]')) AS t FROM conversations) WHERE len(t) > 0""")
def tweet_transform(spark, d):
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return S.transform_tweets(rows, "id", seed=SEED).select("doc_id", "split", F.size("tokens").alias("n"), F.md5(F.array_join("tokens", " ")).alias("digest"))


@query("doc_id:long split:str n:long digest:str", rf"""SELECT doc_id, CASE WHEN {U.format(token_hash_sql('doc_id', '0', 0, SEED))} < 0.8 THEN 'train' ELSE 'test' END AS split, len(t) AS n, md5(array_to_string(t, ' ')) AS digest FROM (
  SELECT page_id * 1048576 AS doc_id, {PREPARED.format("array_to_string(regexp_extract_all(html, '(?is)<p(?:" + chr(92) + "s[^>]*)?>(.*?)</p>', 1), chr(10))")} AS t FROM pages) WHERE len(t) > 0""")
def newswire_transform(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.concat(F.lit("<DOC id='1'>"), "html", F.lit("</DOC>")).alias("text"))
    return S.transform_newswire(rows, "page_id", seed=SEED).select("doc_id", "split", F.size("tokens").alias("n"), F.md5(F.array_join("tokens", " ")).alias("digest"))


@query("n:long digest:str", rf"""SELECT len(t) AS n, md5(array_to_string(t, ' ')) AS digest FROM (
  SELECT {PREPARED.format("array_to_string(regexp_extract_all(html, '(?is)<p(?:" + chr(92) + "s[^>]*)?>(.*?)</p>', 1), chr(10))")} AS t FROM pages) WHERE len(t) > 0""")
def newswire_scan(spark, d):
    """Documents in files that Spark may split anywhere."""
    path = scratch_path(spark, "newswire")
    table(spark, d, "pages").select(F.concat(F.lit("<DOC id='1'>"), "html", F.lit("</DOC>")).alias("value")).write.text(path)
    rows = S.transform_newswire(S.read_newswire(spark, path, "*.txt"), "file_no", place="doc_no")
    return rows.select(F.size("tokens").alias("n"), F.md5(F.array_join("tokens", " ")).alias("digest"))


@query("doc_id:long category:str n:long digest:str", BASE + "\n--\nSELECT doc_id, category, len(tokens) AS n, md5(array_to_string(tokens, ' ')) AS digest FROM base WHERE len(tokens) > 0")
def annotated_roundtrip(spark, d):
    path = scratch_path(spark, "annotated")
    S.write_annotated(documents(spark, d).withColumn("split", F.lit("train")), path)
    return S.read_annotated(spark, path).select("doc_id", "category", F.size("tokens").alias("n"), F.md5(F.array_join("tokens", " ")).alias("digest"))


@query("doc_id:long category:str n:long digest:str", BASE + "\n--\nSELECT doc_id, category, len(tokens) AS n, md5(array_to_string(tokens, ' ')) AS digest FROM base WHERE len(tokens) > 0 AND category IN ('en', 'es')")
def annotated_bytes(spark, d):
    """Annotated documents as Thrift structs; the filter on categories leaves files out."""
    path = scratch_path(spark, "thrift")
    thrift.write_documents(S.annotate(documents(spark, d).withColumn("split", S.bernoulli_split(F.col("doc_id"), 0.6, SEED))), path, "compact")
    rows = thrift.read_documents(spark, path, "compact").where(F.col("category").isin("en", "es"))
    return S.flatten_annotated(rows).select("doc_id", "category", F.size("tokens").alias("n"), F.md5(F.array_join("tokens", " ")).alias("digest"))


@query("doc_id:long category:str split:str n:long digest:str", BASE + f"\n--\nSELECT doc_id, category, CASE WHEN {U.format(token_hash_sql('doc_id', '0', 0, SEED))} < 0.6 THEN 'train' ELSE 'test' END AS split, len(tokens) AS n, md5(array_to_string(tokens, ' ')) AS digest FROM base WHERE category IN ('en', 'fr')")
def labelled_corpus_scan(spark, d):
    path = scratch_path(spark, "labelled")
    S.write_labelled_text(documents(spark, d).withColumn("split", S.bernoulli_split(F.col("doc_id"), 0.6, SEED)), path)
    return S.read_labelled(spark, path, ["en", "fr"]).select("doc_id", "category", "split", F.size("tokens").alias("n"), F.md5(F.array_join("tokens", " ")).alias("digest"))


@query("split:str docs:long tokens:long", BASE + f"\n--\nSELECT split, count(*) AS docs, sum(len(tokens)) AS tokens FROM (SELECT *, CASE WHEN {U.format(token_hash_sql('doc_id', '0', 0, SEED))} < 0.6 THEN 'train' ELSE 'test' END AS split FROM base) GROUP BY split")
def unlabelled_corpus_scan(spark, d):
    path = scratch_path(spark, "unlabelled")
    S.write_labelled_text(documents(spark, d).withColumn("split", S.bernoulli_split(F.col("doc_id"), 0.6, SEED)), path)
    return S.read_unlabelled(spark, path).groupBy("split").agg(F.count("*").alias("docs"), F.sum(F.size("tokens")).alias("tokens"))


@query("doc_id:long category:str n:long", BASE + "\n--\nSELECT doc_id, category, len(tokens) AS n FROM base")
def corpus_sink(spark, d):
    path = scratch_path(spark, "corpus")
    S.write_corpus(documents(spark, d).withColumn("split", S.bernoulli_split(F.col("doc_id"), 0.6, SEED)), path)
    return spark.read.parquet(path).select("doc_id", "category", F.size("tokens").alias("n"))


# vocabulary, encoding, splits


@query("word:str n:long", TOKENS + "\n--\nSELECT word, count(*) AS n FROM toks GROUP BY word")
def word_count(spark, d):
    return vocab.word_counts(documents(spark, d))


@query("word:str word_id:long n:long", VOCAB + "\n--\nSELECT word, word_id, n FROM vocab UNION ALL SELECT '_OOV_', 0, coalesce(sum(n), 0) FROM counted WHERE n <= 1")
def vocab_build(spark, d):
    return vocab.build_vocab(documents(spark, d))


@query("category:str tokens:long oov:long rate:double", ENCODED + "\n--\nSELECT category, count(*) AS tokens, sum(CASE WHEN word_id = 0 THEN 1 ELSE 0 END) AS oov, avg(CASE WHEN word_id = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS rate FROM enc GROUP BY category")
def oov_rate(spark, d):
    unknown = (F.col("word_id") == 0).cast("long")
    return encoded(spark, d)[0].groupBy("category").agg(F.count("*").alias("tokens"), F.sum(unknown).alias("oov"), F.avg(unknown.cast("double")).alias("rate"))


@query("doc_id:long n:long digest:str", ENCODED + "\n--\nSELECT doc_id, count(*) AS n, md5(string_agg(CAST(word_id AS VARCHAR), ' ' ORDER BY pos)) AS digest FROM enc GROUP BY doc_id")
def encode_docs(spark, d):
    docs = documents(spark, d)
    return vocab.encode_docs(docs, keep(vocab.build_vocab(docs), "vocab")).select("doc_id", F.size("word_ids").alias("n"), F.md5(F.array_join(F.col("word_ids").cast("array<string>"), " ")).alias("digest"))


@query("doc_id:long n:long digest:str", TOKENS + ",\nonce AS (SELECT word FROM toks GROUP BY word HAVING count(*) = 1)\n--\nSELECT doc_id, count(*) AS n, md5(string_agg(word, ' ' ORDER BY pos)) AS digest FROM toks WHERE word NOT IN (SELECT word FROM once) GROUP BY doc_id")
def strip_singletons(spark, d):
    return vocab.strip_singletons(documents(spark, d)).select("doc_id", F.size("tokens").alias("n"), F.md5(F.array_join("tokens", " ")).alias("digest"))


@query("category:str docs:long tokens:long longest:long mean:double", BASE + "\n--\nSELECT category, count(*) AS docs, sum(len(tokens)) AS tokens, max(len(tokens)) AS longest, avg(len(tokens)) AS mean FROM base GROUP BY category")
def doc_length_stats(spark, d):
    return documents(spark, d).groupBy("category").agg(F.count("*").alias("docs"), F.sum(F.size("tokens")).alias("tokens"), F.max(F.size("tokens")).alias("longest"), F.avg(F.size("tokens")).alias("mean"))


@query("doc_id:long ordinal:long before:long", BASE + "\n--\nSELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, coalesce(sum(len(tokens)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM base")
def running_tokens(spark, d):
    """The running ordinal of every document, and the tokens before it."""
    return S.running_totals(documents(spark, d).select("doc_id", F.size("tokens").alias("n")), ["doc_id"], "n")


@query("line_no:long doc_id:long", "SELECT row_number() OVER (ORDER BY lang, doc_id) - 1 AS line_no, doc_id FROM documents")
def sorted_scan(spark, d):
    """Lines of all files below a directory, by the order of the files' paths."""
    path = scratch_path(spark, "sorted")
    rows = table(spark, d, "documents").select(F.col("lang").alias("category"), "doc_id", F.col("doc_id").cast("string").alias("value"))
    rows.repartition("category").sortWithinPartitions("category", "doc_id").select("category", "value").write.partitionBy("category").text(path)
    return S.sorted_lines(spark, path).select("line_no", F.col("value").alias("doc_id"))


@query("word:str", "SELECT DISTINCT CAST(user_id AS VARCHAR) || CASE WHEN user_id % 5 = 0 THEN ' x' ELSE '' END AS word FROM events")
def stop_list(spark, d):
    """A stop list from a file with blank lines and trailing blanks."""
    path = scratch_path(spark, "stop")
    users = table(spark, d, "events").select("user_id").distinct()
    word = F.concat(F.col("user_id").cast("string"), F.when(F.col("user_id") % 5 == 0, " x").otherwise(""))
    users.select(F.concat(word, F.lit("  ")).alias("value")).union(users.where("user_id % 3 = 0").select(F.lit("   "))).write.text(path)
    return S.read_stop_list(spark, path)


@query("doc_id:long split:str", f"SELECT doc_id, CASE WHEN {U.format(token_hash_sql('doc_id', '0', 0, SEED))} < 0.6 THEN 'train' ELSE 'test' END AS split FROM documents")
def split_bernoulli(spark, d):
    return table(spark, d, "documents").select("doc_id", S.bernoulli_split(F.col("doc_id"), 0.6, SEED).alias("split"))


@query("doc_id:long ordinal:long part:str", "SELECT doc_id, ordinal, CASE WHEN ordinal < floor((SELECT count(*) FROM documents) * 0.8::DOUBLE) THEN 'train' ELSE 'eval' END AS part FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM documents)")
def split_prefix(spark, d):
    return vocab.prefix_split(table(spark, d, "documents").select("doc_id"), 0.8)


@query("doc_id:long fold:long", "SELECT doc_id, ntile(5) OVER (ORDER BY doc_id) - 1 AS fold FROM documents")
def kfold_assign(spark, d):
    return vocab.kfold(table(spark, d, "documents").select("doc_id"), 5)


@query("id:long ordinal:long split:str", f"SELECT id, ordinal, CASE WHEN ordinal < floor((SELECT count(*) FROM documents) * 0.6::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM (SELECT doc_id AS id, row_number() OVER (ORDER BY {U.format(token_hash_sql('doc_id', '1', 0, SEED))}, doc_id) - 1 AS ordinal FROM documents)")
def split_shuffled(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return S.split_exact(rows, "id", 0.6, SEED).withColumnRenamed("doc_id", "ordinal")


@query("doc_id:long place:long", f"SELECT doc_id, row_number() OVER (ORDER BY {token_hash_sql('doc_id', '7', 0, SEED)}, doc_id) - 1 AS place FROM documents")
def shuffle_docs(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), vocab.shuffle_key(F.col("doc_id"), SEED).alias("h"))
    return S.numbered(rows, ["h", "id"]).select(F.col("id").alias("doc_id"), F.col("doc_id").alias("place"))


@query("doc_id:long", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100")
def take_first(spark, d):
    return vocab.take_first(table(spark, d, "documents").select("doc_id"), 100)


@query("doc_id:long priority:double", f"SELECT doc_id, {U.format(token_hash_sql('doc_id', '3', 0, SEED))} AS priority FROM documents ORDER BY priority, doc_id LIMIT 50")
def reservoir_sample(spark, d):
    return vocab.sample_without_replacement(table(spark, d, "documents").select("doc_id"), 50, SEED)


BY_CATEGORY = f"SELECT category, doc_id FROM (SELECT lang AS category, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {token_hash_sql('doc_id', '3', 0, SEED)}, doc_id) AS r FROM documents{{}}) WHERE r <= 40"
INITIAL = 100


@query("category:str doc_id:long", BY_CATEGORY.format(""))
def reservoir_by_category(spark, d):
    return reservoir.reservoir_by_key(table(spark, d, "documents").select("doc_id", F.col("lang").alias("category")), "category", 40, seed=SEED)


def streamed_reservoirs(spark: SparkSession, rows: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """The state that a stream of rows (doc_id, category), less those of a table, ends with."""
    source, marks = (scratch_path(spark, x) for x in ("reservoir_in", "reservoir_marks"))
    rows.repartition(4).write.parquet(source)
    streamed = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
    if without is not None:
        streamed = streamed.join(without, "doc_id", "left_anti")
    with online.rocksdb(spark):
        changes = reservoir.reservoir_stream(streamed, "category", 40, seed=SEED)
        changes.writeStream.outputMode("update").option("checkpointLocation", marks).trigger(availableNow=True).format("noop").start().awaitTermination()
        return keep(reservoir.stored_reservoirs(spark, marks, "category", 40), "reservoirs")


@query("category:str doc_id:long", BY_CATEGORY.format(""))
def reservoir_stream(spark, d):
    """Reservoirs of a stream, read from its state."""
    return streamed_reservoirs(spark, table(spark, d, "documents").select("doc_id", F.col("lang").alias("category")))


@query("category:str doc_id:long", BY_CATEGORY.format(f" WHERE doc_id NOT IN (SELECT doc_id FROM documents ORDER BY doc_id LIMIT {INITIAL})"))
def reservoir_new_docs(spark, d):
    """Reservoirs of a stream without the initial documents, which are a table."""
    rows = table(spark, d, "documents").select("doc_id", F.col("lang").alias("category"))
    return streamed_reservoirs(spark, rows, keep(vocab.take_first(rows.select("doc_id"), INITIAL), "initial"))


@query("doc_id:long", f"SELECT doc_id FROM documents ORDER BY {U.format(token_hash_sql('doc_id', '3', 0, SEED))}, doc_id LIMIT 1000000000")
def sample_all(spark, d):
    return vocab.sample_without_replacement(table(spark, d, "documents").select("doc_id"), 1_000_000_000, SEED)


@query("doc_id:long category:str", "SELECT doc_id, lang AS category FROM documents WHERE lang IN ('en', 'de') AND doc_id IN (SELECT doc_id FROM labels)")
def semi_category(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("category")).where(F.col("category").isin("en", "de"))
    return docs.join(table(spark, d, "labels"), "doc_id", "left_semi")


@query("category:str", "SELECT unnest(['0', '1', '2', '3', '4']) AS category")
def category_subset(spark, d):
    return spark.createDataFrame([(c,) for c in T.categories("5")], "category string")


@query("word:str n:long", TOKENS + f"\n--\nSELECT word, count(*) AS n FROM toks WHERE word NOT IN {STOP} GROUP BY word")
def anti_stopwords(spark, d):
    stop = spark.createDataFrame([(w,) for w in T.STOP_WORDS], "word string")
    return vocab.word_counts(documents(spark, d)).join(F.broadcast(stop), "word", "left_anti")  # a fixed list


SEED_LINES = ("the 5 of 4 and 3", "que 6 la 2", "der 7 und 1 zzzunknown 9")
SEED_ROWS = ", ".join(f"({k}, '{line.split()[i]}', {line.split()[i + 1]})" for k, line in enumerate(SEED_LINES) for i in range(0, len(line.split()), 2))


def seed_table(spark: SparkSession) -> DataFrame:
    return S.parse_topics(spark.createDataFrame(list(enumerate(SEED_LINES)), "topic int, value string"))


@query("topic:long word:str n:long", f"SELECT * FROM (VALUES {SEED_ROWS}) AS t(topic, word, n)")
def topic_list_parse(spark, d):
    return seed_table(spark)


@query("topic:long word_id:long n:long", COUNTS + f"\n--\nSELECT topic, word_id, sum(n) AS n FROM (SELECT topic, word_id, n FROM tw UNION ALL SELECT s.topic, v.word_id, s.n FROM (VALUES {SEED_ROWS}) AS s(topic, word, n) JOIN vocab v ON s.word = v.word) GROUP BY topic, word_id")
def seed_topics(spark, d):
    docs = documents(spark, d)
    words = keep(vocab.build_vocab(docs), "vocab")
    tw = C.topic_word(C.initial_topics(vocab.encode_tokens(docs, words), K, SEED))
    return C.add_seed_topics(tw, seed_table(spark), words, K)


# counts and topics


@query("topic:long word_id:long n:long", COUNTS + "\n--\nSELECT * FROM tw")
def init_topics_counts(spark, d):
    return C.topic_word(assigned(spark, d)[0])


@query("topic:long n:long", COUNTS + "\n--\nSELECT * FROM tt")
def topic_totals(spark, d):
    return C.topic_totals(C.topic_word(assigned(spark, d)[0]))


@query("topic:long words:long n:long", COUNTS + "\n--\nSELECT topic, CASE WHEN grouping(word_id) = 1 THEN -1 ELSE word_id END AS words, count(*) AS n FROM asg GROUP BY ROLLUP (topic, word_id)")
def topic_word_rollup(spark, d):
    return assigned(spark, d)[0].rollup("topic", "word_id").agg(F.count("*").alias("n"), F.grouping("word_id").alias("g")).select("topic", F.when(F.col("g") == 1, -1).otherwise(F.col("word_id")).alias("words"), "n")


@query("doc_id:long topic:long n:long", COUNTS + "\n--\nSELECT * FROM dt")
def doc_topic_counts(spark, d):
    return C.doc_topic(assigned(spark, d)[0])


@query("topic:long rank:long word_id:long n:long", COUNTS + "\n--\nSELECT * FROM (SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY n DESC, word_id) AS rank, word_id, n FROM tw) WHERE rank <= 50")
def top_words(spark, d):
    return C.ranked_words(C.topic_word(assigned(spark, d)[0]), 50)


@query("topic:long rank:long word_id:long n:long", COUNTS + "\n--\nSELECT topic, row_number() OVER (PARTITION BY topic ORDER BY n DESC, word_id) AS rank, word_id, n FROM tw")
def ranked_words(spark, d):
    return C.ranked_words(C.topic_word(assigned(spark, d)[0]))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = assigned(spark, d)
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("category"))
    return C.inferred_topic(C.doc_topic(rows), docs).join(docs, "doc_id")


@query("doc_id:long category:str topic:long", INFERRED + "\n--\nSELECT * FROM inferred")
def infer_topic(spark, d):
    return labelled(spark, d)


@query("entropy:double", "SELECT -sum(p * ln(p)) AS entropy FROM (SELECT count(*) / CAST((SELECT count(*) FROM documents) AS DOUBLE) AS p FROM documents GROUP BY lang)")
def label_entropy(spark, d):
    return metrics.entropy(table(spark, d, "documents").select("lang"), "lang")


@query("entropy:double", INFERRED + "\n--\nSELECT -sum(p * ln(p)) AS entropy FROM (SELECT count(*) / CAST((SELECT count(*) FROM inferred) AS DOUBLE) AS p FROM inferred GROUP BY topic)")
def topic_entropy(spark, d):
    return metrics.entropy(labelled(spark, d), "topic")


AGREEMENT = """,
cells AS (SELECT category, topic, CAST(count(*) AS DOUBLE) AS c FROM inferred GROUP BY ALL),
marg AS (SELECT *, sum(c) OVER (PARTITION BY category) AS m1, sum(c) OVER (PARTITION BY topic) AS m2, sum(c) OVER () AS n FROM cells),
sums AS (SELECT sum(c / n * (ln(c * n) - ln(m1 * m2))) AS mi, -sum(c / n * ln(m1 / n)) AS h_label, -sum(c / n * ln(m2 / n)) AS h_topic FROM marg)"""


@query("mi:double", INFERRED + AGREEMENT + "\n--\nSELECT mi FROM sums")
def mutual_information(spark, d):
    return metrics.agreement(labelled(spark, d), "category", "topic")


@query("mi:double h_label:double h_topic:double nmi:double", INFERRED + AGREEMENT + "\n--\nSELECT *, CASE WHEN h_label + h_topic > 0 THEN 2 * mi / (h_label + h_topic) ELSE 0 END AS nmi FROM sums")
def nmi(spark, d):
    return metrics.agreement(labelled(spark, d), "category", "topic")


@query("word_id:long df:long", ENCODED + "\n--\nSELECT word_id, count(DISTINCT doc_id) AS df FROM enc GROUP BY word_id")
def doc_freq(spark, d):
    docs = documents(spark, d)
    ids = vocab.encode_docs(docs, keep(vocab.build_vocab(docs), "vocab"))
    return metrics.document_frequency(ids.select("doc_id", F.explode(F.array_distinct("word_ids")).alias("word_id")))


TOP = """,
top AS (SELECT * FROM (SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY n DESC, word_id) AS rank, word_id FROM tw) WHERE rank <= 10),
held AS (SELECT DISTINCT p.topic, p.rank, e.doc_id FROM enc e JOIN top p ON e.word_id = p.word_id),
codf AS (SELECT i.topic, i.rank AS rank_i, j.rank AS rank_j, count(*) AS codf FROM held i JOIN held j ON i.topic = j.topic AND i.doc_id = j.doc_id AND i.rank > j.rank GROUP BY ALL)"""


def top_and_tokens(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = keep(assigned(spark, d)[0], "assigned")
    return rows, keep(C.ranked_words(C.topic_word(rows), 10), "top")


@query("topic:long rank_i:long rank_j:long codf:long", COUNTS + TOP + "\n--\nSELECT * FROM codf")
def codoc_freq(spark, d):
    return metrics.codocument_frequency(*top_and_tokens(spark, d))


@query("coherence:double skipped:long", COUNTS + TOP + f"""
--
SELECT sum(CASE WHEN f.df IS NULL THEN 0 ELSE ln(coalesce(c.codf, 0) + 1.0::DOUBLE) - ln(f.df) END) / {K} AS coherence, sum(CASE WHEN f.df IS NULL THEN 1 ELSE 0 END) AS skipped FROM top i JOIN top j ON i.topic = j.topic AND i.rank > j.rank
LEFT JOIN (SELECT topic, rank, count(DISTINCT doc_id) AS df FROM held GROUP BY ALL) f ON f.topic = j.topic AND f.rank = j.rank LEFT JOIN codf c ON c.topic = i.topic AND c.rank_i = i.rank AND c.rank_j = j.rank""")
def coherence(spark, d):
    return metrics.coherence(*top_and_tokens(spark, d), K)


# the posterior and samplers


@query("doc_id:long topic:long mass:double", COUNTS + grid(False) + "\n--\nSELECT doc_id, k AS topic, sum(p) AS mass FROM grid GROUP BY doc_id, k")
def posterior_grid(spark, d):
    rows, size = kept_documents(spark, d)
    return D.topic_mass(rows, K, size, ALPHA, BETA).select("doc_id", F.posexplode("mass").alias("topic", "mass"))


@query("doc_id:long n:long ll:double", COUNTS + grid(False) + "\n--\nSELECT doc_id, count(*) AS n, sum(ln(s)) AS ll FROM (SELECT doc_id, pos, sum(p) AS s FROM grid GROUP BY doc_id, pos) GROUP BY doc_id")
def predictive_prob(spark, d):
    rows, size = kept_documents(spark, d)
    return D.log_predictive(rows, K, size, ALPHA, BETA)


@query("doc_id:long pos:long topic:long", COUNTS + grid(False) + drawn(1) + "\n--\nSELECT doc_id, pos, topic FROM swept")
def sample_topic(spark, d):
    rows, size = kept_documents(spark, d)
    return D.drawn(rows, K, size, 1, ALPHA, BETA, SEED).select("doc_id", F.posexplode("topics").alias("pos", "topic"))


@query("topic:long word_id:long n:long", COUNTS + grid(True) + drawn(1) + "\n--\nSELECT topic, word_id, count(*) AS n FROM swept GROUP BY ALL")
def gibbs_sync_sweep(spark, d):
    rows, size = kept_documents(spark, d)
    return D.topic_word(D.drawn(rows, K, size, 1, ALPHA, BETA, SEED, leave_out=True), K)


PHI = COUNTS + f""",
phi AS (SELECT w.word_id, list((coalesce(t.n, 0) + {BETA}::DOUBLE) / ((SELECT n FROM tt WHERE topic = g.k) + (SELECT v FROM size) * {BETA}::DOUBLE) ORDER BY g.k) AS phi
  FROM (SELECT DISTINCT word_id FROM tw) w CROSS JOIN {GRID_TOPICS} g LEFT JOIN tw t ON t.topic = g.k AND t.word_id = w.word_id GROUP BY w.word_id),
seqs AS (SELECT e.doc_id, list({{'dt': p.phi, 'n': 0.0::DOUBLE, 'll': 0.0::DOUBLE}} ORDER BY e.pos) AS phis FROM enc e JOIN phi p ON e.word_id = p.word_id GROUP BY e.doc_id),
zero AS (SELECT doc_id, list_prepend({{'dt': list_transform(range({K}), lambda k: 0.0::DOUBLE), 'n': 0.0::DOUBLE, 'll': 0.0::DOUBLE}}, phis) AS phis FROM seqs),
first AS (SELECT doc_id, len(phis) - 1 AS n, list_reduce(phis, lambda a, w: {{
  'dt': list_transform(range(1, {K + 1}), lambda k: a.dt[k] + w.dt[k] * (a.dt[k] + {ALPHA}::DOUBLE) / list_sum(list_transform(range(1, {K + 1}), lambda j: w.dt[j] * (a.dt[j] + {ALPHA}::DOUBLE)))),
  'n': a.n + 1, 'll': a.ll + ln(list_sum(list_transform(range(1, {K + 1}), lambda j: w.dt[j] * (a.dt[j] + {ALPHA}::DOUBLE))) / (a.n + {K * ALPHA}::DOUBLE))}}).ll AS ll FROM zero)"""


def modelled(spark: SparkSession, d: str):
    """Documents with word_ids, and the model of their hashed topics, sent to the tasks."""
    docs = documents(spark, d)
    words = keep(vocab.build_vocab(docs), "vocab")
    ids = keep(vocab.encode_docs(docs, words), "encoded")
    return ids, likelihood.sent_model(C.topic_word(C.initial_topics(runs.long_ids(ids), K, SEED)), K, words.count(), BETA)


def first_moments(spark: SparkSession, d: str) -> DataFrame:
    return likelihood.first_moment_docs(*modelled(spark, d), K, ALPHA)


@query("doc_id:long n:long ll:double", PHI + "\n--\nSELECT doc_id, n, ll FROM first")
def first_moment_ll(spark, d):
    return first_moments(spark, d)


@query("n:long perplexity:double", PHI + "\n--\nSELECT sum(n) AS n, exp(-sum(ll) / sum(n)) AS perplexity FROM first")
def perplexity(spark, d):
    return likelihood.perplexity(first_moments(spark, d))


# particles: a user's events stand for a run's particles

PARTICLES = "particles AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS particle, event_id, abs(value) + 1 AS raw FROM events)"
WEIGHTS = PARTICLES + ",\nweights AS (SELECT run, particle, event_id, raw / sum(raw) OVER (PARTITION BY run) AS weight FROM particles)"


def particles(spark: SparkSession, d: str) -> DataFrame:
    rank = F.row_number().over(metrics.Window.partitionBy("user_id").orderBy("event_id")) - 1
    return table(spark, d, "events").select(F.col("user_id").alias("run"), rank.alias("particle"), "event_id", (F.abs("value") + 1).alias("weight"))


@query("run:long ess:double", WEIGHTS + "\n--\nSELECT run, 1 / sum(weight * weight) AS ess FROM weights GROUP BY run")
def particle_ess(spark, d):
    return metrics.effective_sample_size(particles(spark, d), "run")


@query("run:long particle:long weight:double", WEIGHTS + "\n--\nSELECT run, particle, weight FROM weights")
def weight_normalise(spark, d):
    return metrics.normalised_weights(particles(spark, d), "run")


@query("run:long particle:long weight:double", PARTICLES + "\n--\nSELECT run, particle, raw AS weight FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY raw DESC, particle) AS r FROM particles) WHERE r = 1")
def best_particle(spark, d):
    return metrics.best_particle(particles(spark, d), "run")


@query("run:long particle:long source:long", WEIGHTS + f""",
cmf AS (SELECT *, sum(weight) OVER (PARTITION BY run ORDER BY particle) AS high, max(particle) OVER (PARTITION BY run) AS last FROM weights),
picks AS (SELECT d.run, d.particle AS draw, min(c.particle) AS particle FROM particles d JOIN cmf c ON c.run = d.run AND (c.high > {U.format(token_hash_sql('d.event_id', '2', 0, SEED))} OR c.particle = c.last) GROUP BY ALL),
times AS (SELECT run, particle, count(*) AS n FROM picks GROUP BY ALL),
extra AS (SELECT run, source, row_number() OVER (PARTITION BY run ORDER BY source, copy) AS k FROM (SELECT run, particle AS source, unnest(range(2, n + 1)) AS copy FROM times)),
free AS (SELECT run, particle, row_number() OVER (PARTITION BY run ORDER BY particle) AS k FROM particles p WHERE NOT EXISTS (SELECT 1 FROM times t WHERE t.run = p.run AND t.particle = p.particle))
--
SELECT run, particle, particle AS source FROM times UNION ALL SELECT f.run, f.particle, e.source FROM free f JOIN extra e ON f.run = e.run AND f.k = e.k""")
def particle_resample(spark, d):
    weights = metrics.normalised_weights(particles(spark, d), "run")
    draws = weights.select("run", F.col("particle").alias("draw"), uniform(F.col("event_id"), F.lit(2), 0, SEED).alias("u"))
    return metrics.resample_plan(weights.select("run", "particle", "weight"), draws, "run")


# traces: every tenth event is an iteration mark, the others are metric lines

LINES = "lines AS (SELECT 'run.' || (user_id % 3) AS run, event_id AS line, CASE WHEN event_id % 10 = 0 THEN 'doc: ' || event_id WHEN event_type = 'error' THEN 'resampling: 1' ELSE 'In-Sample NMI: ' || CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR) END AS value FROM events)"
PARSED = LINES + """,
keyed AS (SELECT run, line, regexp_replace(lower(trim(substr(value, 1, instr(value, ':') - 1))), '[^a-zA-Z0-9_]', '_', 'g') AS metric, trim(substr(value, instr(value, ':') + 1)) AS value FROM lines),
parsed AS (SELECT run, line, iter, metric, value FROM (SELECT *, coalesce(last_value(CASE WHEN metric = 'doc' THEN CAST(value AS BIGINT) END IGNORE NULLS) OVER (PARTITION BY run ORDER BY line), 0) AS iter FROM keyed) WHERE metric <> 'doc')"""
RUNS = ["run.0", "run.1", "run.2"]


def log_lines(spark: SparkSession, d: str) -> DataFrame:
    e, i = table(spark, d, "events"), F.col("event_id")
    value = F.when(i % 10 == 0, F.concat(F.lit("doc: "), i.cast("string"))).when(F.col("event_type") == "error", "resampling: 1").otherwise(F.concat(F.lit("In-Sample NMI: "), F.floor(F.col("value") * 100).cast("string")))
    return e.select(F.concat(F.lit("run."), (F.col("user_id") % 3).cast("string")).alias("run"), i.alias("line"), value.alias("value"))


def wide_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace(".", "_") for c in df.columns])


@query("run:str iter:long metric:str value:str", PARSED + "\n--\nSELECT run, iter, metric, value FROM parsed")
def trace_parse(spark, d):
    return trace.parse(log_lines(spark, d))


@query("iter:long run_0:str run_1:str run_2:str", PARSED + "\n--\nSELECT iter, " + ", ".join(f"arg_max(value, line) FILTER (WHERE run = 'run.{k}') AS run_{k}" for k in range(3)) + " FROM parsed WHERE metric = 'in_sample_nmi' GROUP BY iter")
def trace_pivot(spark, d):
    return wide_names(trace.stat_pivot(trace.parse(log_lines(spark, d)), "in_sample_nmi", RUNS))


@query("iter:long run_0:long run_1:long run_2:long", PARSED + "\n--\nSELECT iter, " + ", ".join(f"count(*) FILTER (WHERE run = 'run.{k}') AS run_{k}" for k in range(3)) + " FROM parsed WHERE metric = 'resampling' GROUP BY iter")
def trace_count_pivot(spark, d):
    return wide_names(trace.count_pivot(trace.parse(log_lines(spark, d)), "resampling", RUNS))


LONG = PARSED + ",\nlong AS (SELECT iter, run, arg_max(value, line) AS v FROM parsed WHERE metric = 'in_sample_nmi' GROUP BY iter, run)"


@query("iter:long run:str val:double experiment:str", LONG + "\n--\nSELECT iter, run, CAST(v AS DOUBLE) AS val, 'e1' AS experiment FROM long")
def trace_unpivot(spark, d):
    return trace.unpivot(trace.stat_pivot(trace.parse(log_lines(spark, d)), "in_sample_nmi", RUNS), experiment="e1")


@query("experiment:str iter:long mean:double low:double high:double runs:long", LONG + "\n--\nSELECT 'e1' AS experiment, iter, avg(CAST(v AS DOUBLE)) AS mean, avg(CAST(v AS DOUBLE)) - coalesce(stddev_samp(CAST(v AS DOUBLE)), 0) AS low, avg(CAST(v AS DOUBLE)) + coalesce(stddev_samp(CAST(v AS DOUBLE)), 0) AS high, count(*) AS runs FROM long GROUP BY iter")
def trace_summary(spark, d):
    long = trace.unpivot(trace.stat_pivot(trace.parse(log_lines(spark, d)), "in_sample_nmi", RUNS), experiment="e1")
    return trace.summary(long, "experiment", "iter")


@query("iter:long run_0:str run_1:str run_2:str", PARSED + "\n--\nSELECT iter, " + ", ".join(f"arg_max(value, line) FILTER (WHERE run = 'run.{k}') AS run_{k}" for k in range(3)) + " FROM parsed WHERE metric = 'in_sample_nmi' GROUP BY iter")
def trace_tsv(spark, d):
    path = scratch_path(spark, "trace")
    trace.write_tsv(trace.stat_pivot(trace.parse(log_lines(spark, d)), "in_sample_nmi", RUNS), path)
    return wide_names(spark.read.option("sep", "\t").option("header", True).option("nullValue", "NA").csv(path))


@query("dataset:str metric:str iter:long value:str", LINES + """,
keyed AS (SELECT run, line, regexp_replace(lower(trim(substr(value, 1, instr(value, ':') - 1))), '[^a-zA-Z0-9_]', '_', 'g') AS metric, trim(substr(value, instr(value, ':') + 1)) AS value FROM lines),
marked AS (SELECT * FROM (SELECT *, last_value(CASE WHEN metric = 'doc' THEN CAST(value AS BIGINT) END IGNORE NULLS) OVER (PARTITION BY run ORDER BY line) AS iter FROM keyed) WHERE metric <> 'doc' AND iter IS NOT NULL)
--
SELECT 'dataset=' || run AS dataset, metric, iter, CASE WHEN metric = 'resampling' THEN CAST(count(*) AS VARCHAR) ELSE arg_max(value, line) END AS value FROM marked GROUP BY run, metric, iter""")
def trace_directory(spark, d):
    """Tables of metrics from a directory of logs, one log a data set."""
    logs, out = scratch_path(spark, "logs"), scratch_path(spark, "tables")
    rows = log_lines(spark, d).withColumnRenamed("run", "dataset")
    rows.repartition("dataset").sortWithinPartitions("dataset", "line").select("dataset", "value").write.partitionBy("dataset").text(logs)
    found = None
    for dataset in trace.process_logs(spark, logs, out):  # a few data sets
        for metric in ("in_sample_nmi", "resampling"):
            one = spark.read.option("sep", "\t").option("header", True).option("nullValue", "NA").schema("iter bigint, value string").csv(f"{out}/{dataset}_{metric}")
            one = one.select(F.lit(dataset).alias("dataset"), F.lit(metric).alias("metric"), "iter", "value")
            found = one if found is None else found.union(one)
    return found


@query("event_type:str run:long score:double", "SELECT event_type, run, score FROM (SELECT event_type, event_id AS run, value AS score, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1")
def best_run(spark, d):
    return selection.best_run(table(spark, d, "events").select("event_type", F.col("event_id").alias("run"), F.col("value").alias("score")), "event_type")


@query("user_id:long score:double", "SELECT user_id, score FROM (SELECT user_id, value AS score, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE k = n // 2")
def median_fold(spark, d):
    return selection.upper_median(table(spark, d, "events").select("user_id", F.col("value").alias("score")), "user_id")


# samplers and streams, which SQL does not express


def turns(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """Encoded conversation turns of two runs, by role."""
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.col("role").alias("category"), F.lit("train").alias("split"), T.prepared(F.col("text"), stop=T.STOP_WORDS).alias("tokens"))
    docs, words = runs.encoded_corpus(rows)
    return docs.select(F.col("category").alias("run_id"), F.lit(SEED).cast("long").alias("seed"), F.col("doc_id").alias("ord"), "doc_id", "category", "word_ids"), words.count()


FILTER = FilterParams.of(num_particles=8, num_topics=3, reservoir_size=50, init_num_docs=20, init_num_iters=5, rejuv_sample_size=5, ess_threshold=4.0)


@query("topic:long word_id:long n:long")
def gibbs_exact(spark, d):
    docs = documents(spark, d)
    words = keep(vocab.build_vocab(docs), "vocab")
    rows = vocab.encode_docs(docs, words).join(docs.select("doc_id", "category"), "doc_id").select(F.col("category").alias("run_id"), F.lit(SEED).alias("seed"), "doc_id", "word_ids")
    return C.topic_word(gibbs.assignments(keep(gibbs.gibbs_runs(rows, words.count(), K, ALPHA, BETA, 3), "state")))


@query("topic:long word_id:long n:long")
def gibbs_distributed(spark, d):
    docs = documents(spark, d)
    words = keep(vocab.build_vocab(docs), "vocab")
    state = gibbs.distributed_gibbs(vocab.encode_docs(docs, words), keep, words.count(), K, ALPHA, BETA, 3, SEED)
    return C.topic_word(gibbs.assignments(state.withColumn("run_id", F.lit("run.0"))))


@query("topic:long word_id:long n:long")
def gibbs_rotating(spark, d):
    """Many topics, documents and words in blocks that meet in turn."""
    docs = documents(spark, d)
    words = keep(vocab.build_vocab(docs), "vocab")
    state = rotation.rotating_gibbs(keep(vocab.encode_docs(docs, words), "encoded"), keep, words.count(), 128, ALPHA, BETA, 1, SEED, blocks=4)
    return C.topic_word(gibbs.assignments(state.withColumn("run_id", F.lit("run.0"))))


@query("doc_id:long topic:long")
def gibbs_infer(spark, d):
    return gibbs.infer_docs(*modelled(spark, d), K, ALPHA, 3, SEED)


@query("doc_id:long n:long ll:double")
def ltr_ll(spark, d):
    docs, size = turns(spark, d)
    tokens = keep(C.initial_topics(runs.long_ids(docs), K, SEED), "tokens")
    return likelihood.left_to_right(likelihood.with_phi(tokens, C.topic_word(tokens), K, size, BETA), K, ALPHA, 5, SEED)


@query("doc_id:long category:str split:str n:long")
def generate_corpus(spark, d):
    return S.generate_corpus(spark, seed=SEED).select("doc_id", "category", "split", F.size("tokens").alias("n"))


@query("run_id:str iter:long metric:str value:double")
def particle_filter_replay(spark, d):
    docs, size = turns(spark, d)
    return particle.events_of(particle.replay_all(docs, FILTER.dict(), size))


@query("run_id:str doc_id:long label:long")
def particle_filter_stream(spark, d):
    docs, size = turns(spark, d)
    source, out, marks = (scratch_path(spark, x) for x in ("stream_in", "stream_out", "stream_marks"))
    docs.repartitionByRange(4, "ord").write.parquet(source)
    with online.rocksdb(spark):
        stream = particle.filter_stream(spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 2).parquet(source), FILTER.dict(), size)
        write = stream.writeStream.outputMode("update").option("checkpointLocation", marks).trigger(availableNow=True)
        write.foreachBatch(lambda batch, _: batch.write.mode("append").parquet(out)).start().awaitTermination()
    return particle.latest_labels(spark.read.schema(particle.LABELS).parquet(out))


def online_run(spark: SparkSession, d: str, **how) -> online.OnlineRun:
    """Filters of a stream of turns by role, a fifth of which models are evaluated on."""
    docs, size = turns(spark, d)
    docs = keep(docs, "turns")
    test = keep(docs.where("doc_id % 5 = 0").select("doc_id", "category", "word_ids"), "test")
    run = online.OnlineRun(spark, scratch_path(spark, "online"), FILTER, size, test, labelled=False, eval_every=500, **how)
    source = scratch_path(spark, "online_in")
    docs.where("doc_id % 5 <> 0").repartitionByRange(4, "ord").write.parquet(source)
    run.start(spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 2).parquet(source), availableNow=True).awaitTermination()
    return run


@query("run_id:str iter:long metric:str value:double")
def online_filter(spark, d):
    """Metrics of a stream that evaluates its models as it runs, and when it ends."""
    run = online_run(spark, d)
    run.finish()
    return run.metrics()


@query("kind:str run_id:str particle:long topic:long word_id:long doc_id:long n:long")
def filter_state(spark, d):
    """Every particle's model, the reservoir and open labels, from a stream's state."""
    with online.rocksdb(spark):
        return keep(online_run(spark, d).dump(), "dump")


@query("run_id:str iter:long metric:str value:double")
def filter_from_model(spark, d):
    """Filters that go on from models learned by exact Gibbs on the first hundred turns of a role."""
    docs, size = turns(spark, d)
    docs = keep(docs, "turns")
    first = keep(first_of_runs(docs, 100), "first")
    rest = docs.join(first.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    sampled = gibbs.gibbs_runs(first, size, FILTER.num_topics, FILTER.alpha, FILTER.beta, 5)
    starts = particle.starts_from(sampled.join(first.drop("run_id", "word_ids"), "doc_id"), FILTER.dict())
    return particle.events_of(particle.replay_all(rest, FILTER.dict(), size, eval_every=500, starts=keep(starts, "starts_of")))


def first_of_runs(docs: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(metrics.Window.partitionBy("run_id").orderBy("ord"))
    return docs.withColumn("r", rank).where(F.col("r") <= n).drop("r")


@query("run:long score:double")
def model_select(spark, d):
    docs, size = turns(spark, d)
    p = FilterParams.of(num_topics=2, init_num_iters=3, init_tune_num_runs=2, init_tune_num_cv_folds=3)
    return runs.best_of(runs.select_model(docs.select("ord", "doc_id", "category", "word_ids"), size, p, SEED))


@query("num_topics:long run_id:str iter:long metric:str value:double")
def param_sweep(spark, d):
    docs, size = turns(spark, d)
    base = FILTER.dict() | {"num_particles": 4, "init_num_docs": 10}
    base.pop("num_topics")
    return runs.sweep(spark, docs.select("doc_id", "category", "word_ids"), size, {"num_topics": [2, 3]}, 2, base)


@query("metric:str value:double")
def eval_bundle(spark, d):
    docs, size = turns(spark, d)
    tokens = keep(C.initial_topics(runs.long_ids(docs), K, SEED), "tokens")
    p = FilterParams.of(num_topics=K, init_seed=SEED, test_num_iters=2)
    return runs.evaluate(keep(C.topic_word(tokens), "model"), docs, size, p)


def labelled_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns with their role as category, three fifths for training."""
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.col("role").alias("category"), T.prepared(F.col("text"), stop=T.STOP_WORDS).alias("tokens"))
    return rows.withColumn("split", S.bernoulli_split(F.col("doc_id"), 0.6, SEED))


@query("iter:long metric:str value:double")
def run_filter(spark, d):
    """A whole online run: tuned initial documents, the filter, evaluations on the way."""
    return runs.run_filter(labelled_corpus(spark, d), **(FILTER.dict() | {"init_seed": SEED, "init_tune_num_runs": 2, "test_num_iters": 2})).metrics


@query("iter:long metric:str value:double")
def run_gibbs(spark, d):
    return runs.run_gibbs(labelled_corpus(spark, d), init_seed=SEED, init_num_iters=12, test_num_iters=2).metrics


@query("iter:long metric:str value:double")
def run_batch(spark, d):
    return runs.run_batch(labelled_corpus(spark, d), init_seed=SEED, num_iters=5).metrics


@query("rank:long seed:long score:double")
def seed_search(spark, d):
    return runs.find_seeds(labelled_corpus(spark, d), 6, init_seed=SEED, init_num_docs=60, init_num_iters=5)


@query("topic:long rank:long word:str n:long", COUNTS + "\n--\nSELECT r.topic, r.rank, coalesce(v.word, '_OOV_') AS word, r.n FROM (SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY n DESC, word_id) AS rank, word_id, n FROM tw) r LEFT JOIN vocab v ON r.word_id = v.word_id WHERE r.rank <= 10")
def topic_report(spark, d):
    """Flagship: the top words of every topic, from raw text on."""
    docs = documents(spark, d)
    words = keep(vocab.build_vocab(docs), "vocab")
    tw = C.topic_word(C.initial_topics(vocab.encode_tokens(docs, words), K, SEED))
    return C.ranked_words(tw, 10).join(words.select("word_id", "word"), "word_id")
