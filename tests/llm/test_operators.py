"""Each operator against a brute-force version, and on awkward and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

WORD = re.compile("[^\x20\x09-\x0d]+")
SF = "/root/testdata/sf0.001"


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, n=5):
    w = WORD.findall(fold(text))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def unions(ids, links):
    parent = {k: k for k in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in ids}


# 1: token ids


@pytest.fixture(scope="module")
def tokenizers():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    out = {}
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        out[name] = (P.path(name), Tokenizer.from_file(P.path(name)))
    return out


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(tokenizers, name):
    from topicloom.llm.tokens import Encoder

    path, library = tokenizers[name]
    rng = random.Random(3)
    atoms = [*"ab Z9  \n\n\t.,'!é́Σİ　\x85\x1c中😀", "'s", "'ll", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", " the", "  ", "\r\n"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["The cat, the dog. And the", "a  b", "a   b", " lead", "trail ", "x\n y", "x \ny", "x\n\ny", None, ""]
    e = Encoder(path, limit=500)
    for part in (texts, texts[::-1]):
        for t, ids in zip(part, e.encode(part), strict=True):
            assert np.frombuffer(ids, e.kind).tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_with_signs_are_learned_together(tokenizers, name):
    """Letters with a run of signs behind: ids are the library's, and few texts are
    given to it, not one a word."""
    from topicloom.llm.tokens import SIGNS, Encoder

    path, library = tokenizers[name]
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeéñßÀÖXYZ", k=6)) + "".join(rng.choices(SIGNS, k=rng.randint(0, 4))) for _ in range(4000)]
    texts = [" ".join(words[k : k + 40]) for k in range(0, len(words), 40)] + ["it's, 'tis' a'.' b.'s c,'ll d!\ne?? f\n***", ",,, ... a", "STRASSE... ß!!\nİ.. K.."]
    e, given = Encoder(path), []
    many, one = e._many, e._one
    e._many = lambda x, direct=False: given.extend(x) or many(x, direct)
    e._one = lambda x: given.append(x) or one(x)
    for _ in range(3):
        for t, ids in zip(texts, e.encode(texts), strict=True):
            assert np.frombuffer(ids, e.kind).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
    signs = {w.lstrip("abcdeéñßÀÖXYZ") for w in words}
    assert len(given) < len(signs) + 200 < len(words)


def test_token_orc(spark, awkward, nothing, scratch, tokenizers):
    from topicloom.llm.tokens import digest, read_orc, write_orc

    path, library = tokenizers["byte_bpe_50k.json"]
    write_orc(awkward, scratch.path("a"), path, 0)
    rows = sorted(digest(read_orc(spark, scratch.path("a"))).collect(), key=lambda r: (r.doc_id, r.start))
    at = 0
    texts = sorted((r.doc_id, r.text or "") for r in awkward.collect())
    assert len(rows) == len(texts)
    for r, (doc, text) in zip(rows, texts, strict=True):
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    one = spark.read.orc(scratch.path("a")).where("doc_id = 6").collect()
    assert len(one) == 1
    write_orc(nothing, scratch.path("b"), path, 0)
    assert digest(read_orc(spark, scratch.path("b"))).count() == 0


def test_orc_prunes(spark, scratch, tokenizers):
    """A written file has several stripes and row groups; statistics and the Bloom
    filter on doc_id spare a reader nearly all of them."""
    from pyarrow import orc

    from topicloom.llm.tokens import read_orc, write_orc

    n = 60_000
    docs = spark.range(n).select((F.col("id") * 3).alias("doc_id"), F.concat_ws(" ", *[F.md5(F.concat(F.col("id").cast("string"), F.lit(k))) for k in range(3)]).alias("text")).coalesce(1)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        write_orc(docs, scratch.path("many"), tokenizers["byte_bpe_50k.json"][0], 0, stripe_bytes=1 << 20, index_rows=1000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    import glob

    files = glob.glob(f"{scratch.path('many').removeprefix('file:')}/*.orc")
    stripes = sum(orc.ORCFile(f).nstripes for f in files)
    assert stripes >= 3 and sum(orc.ORCFile(f).nrows for f in files) == n
    raw = b"".join(open(f, "rb").read() for f in files)
    jvm = spark._jvm
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(files[0]), jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
    footer = [reader.getStripes().get(k) for k in range(reader.getStripes().size())]
    assert all(x.getIndexLength() > 0 for x in footer) and raw
    stats = reader.getStripeStatistics()
    ranges = [(stats.get(k).getColumnStatistics()[1].getMinimum(), stats.get(k).getColumnStatistics()[1].getMaximum()) for k in range(stats.size())]
    assert all(a[1] < b[0] for a, b in zip(ranges[:-1], ranges[1:], strict=True))  # stripes hold ranges of ids

    def rows_read(condition):
        """Rows that leave the scan."""
        df = spark.read.schema("doc_id bigint, ids array<int>").orc(scratch.path("many")).where(condition)
        assert "PushedFilters: [" in df._jdf.queryExecution().explainString(jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        got = df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        return got, plan

    def scanned(condition):
        spark.conf.set("spark.sql.orc.filterPushdown", "true")
        df = spark.read.schema("doc_id bigint").orc(scratch.path("many")).where(condition)
        seen = spark.sparkContext.accumulator(0)

        def count(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        # without pushing, the condition runs behind the scan; what the scan gives is what metadata left
        plan = df._jdf.queryExecution().executedPlan()
        df._jdf.queryExecution().toRdd().count()
        leaves = plan.collectLeaves()
        return leaves.apply(0).metrics().apply("numOutputRows").value()

    one, _ = rows_read("doc_id = 90000")
    assert len(one) == 1 and scanned("doc_id = 90000") <= 1000
    assert scanned("doc_id = 90001") == 0  # within the range of a row group, but in no Bloom filter
    assert scanned("doc_id between 30000 and 36000") <= 5000
    assert scanned("doc_id >= 0") == n


# 2: near duplicates


def near_expected(rows):
    sets = {r.doc_id: shingles(r.text) for r in rows}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, unions(ids, links)


def test_near_duplicates_awkward(awkward, nothing, scratch, spark):
    from topicloom.llm.common import Scratch
    from topicloom.llm.near import near_duplicates

    sets, of = near_expected(awkward.collect())
    for r in near_duplicates(awkward, scratch).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), of[r.doc_id], of[r.doc_id] == r.doc_id)
    assert near_duplicates(nothing, Scratch(spark, "test")).count() == 0


def test_near_duplicates_in_a_large_group(spark, scratch):
    """A chain and a crowd of copies whose leader does not link with all."""
    from topicloom.llm.near import near_duplicates

    rng = random.Random(1)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for _ in range(120):
        words = list(base)
        for k in rng.sample(range(150), rng.randint(0, 9)):
            words[k] = f"new{rng.random()}"
        texts.append(" ".join(words))
    rows = [Row(doc_id=k, text=t) for k, t in enumerate(texts)]
    sets, of = near_expected(rows)
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows), scratch).collect()}
    assert sum(got[k] != of[k] for k in of) <= 1  # candidates are banded: links at the very threshold may be missed


def test_pruning_keeps_the_miss_probability():
    from topicloom.llm.near import prune_table

    table = prune_table(200, 40, 0.75, 1e-4)
    rng = np.random.default_rng(0)
    agree = np.cumsum(rng.random((20000, 200)) < 0.75, 1)
    missed = np.zeros(len(agree), bool)
    for n, least in table.items():
        missed |= agree[:, n - 1] < least
    assert missed.mean() < 0.01


# 3: licenses


def license_words(t):
    return [w for w in re.split("[^a-z0-9]+", (t or "").lower()) if w]


def licenses_expected(rows):
    """(doc_id, license, template) of texts that hold three quarters of a
    template's shingles in one stretch of three of its size classes."""
    from topicloom.llm.licenses import TEMPLATES

    want = set()
    for doc, text in rows:
        w = license_words(text)
        at = defaultdict(list)
        for i in range(len(w) - 4):
            at[" ".join(w[i : i + 5])].append(i)
        for name, given in TEMPLATES.items():
            for k, t in enumerate(given):
                t = license_words(t)
                s = {" ".join(t[i : i + 5]) for i in range(len(t) - 4)}
                places = sorted(i for x in s for i in at[x])
                reach = 1.5 * 2 ** int(np.ceil(np.log2(len(s))))
                if any(len({" ".join(w[i : i + 5]) for i in places if p <= i < p + reach} & s) >= 0.75 * len(s) for p in places):
                    want.add((doc, name, k))
    return want


def test_licenses(awkward, nothing, spark):
    from topicloom.llm.licenses import MIT, scan_licenses

    words = license_words(MIT)
    texts = {100: "intro words here " + MIT + " and more", 101: " ".join(words[: len(words) * 8 // 10]) + " something else altogether", 102: "licensed", 103: " ".join(words[: len(words) // 2])}
    rows = [(r.doc_id, r.text) for r in awkward.collect()] + list(texts.items())
    docs = awkward.select("doc_id", "text").union(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    found = scan_licenses(docs).collect()
    got = {(r.doc_id, r.license, r.template) for r in found}
    assert got == licenses_expected(rows)
    assert {100, 101, 13} <= {x[0] for x in got} and not {102, 103} & {x[0] for x in got}
    whole = next(r for r in found if (r.doc_id, r.license, r.template) == (100, "mit", 1))
    assert whole.containment == 1 and whole.first_word == 3 and whole.windows >= 1
    assert next(r for r in found if (r.doc_id, r.license) == (101, "mit")).first_word == 0
    assert scan_licenses(nothing).count() == 0
    # rows that repeat an id are read apart
    twice = spark.createDataFrame([(1, MIT), (1, "nothing of the kind " * 60), (1, "Released under the MIT License")], "doc_id long, text string")
    assert {(r.doc_id, r.license, r.template) for r in scan_licenses(twice).collect()} == {(1, "mit", 0), (1, "mit", 1)}


def test_license_bands_miss_little(spark):
    """Texts of all licenses with words changed, between other words: what the
    bands retrieve against every stretch compared."""
    from topicloom.llm.licenses import TEMPLATES, scan_licenses

    rng = random.Random(7)
    rows = []
    for k in range(240):
        name = rng.choice(sorted(TEMPLATES))
        t = license_words(max(TEMPLATES[name], key=len))
        for _ in range(rng.randint(0, max(1, len(t) // 18))):
            t[rng.randrange(len(t))] = f"w{rng.random()}"[:6].replace(".", "")
        around = [[f"x{rng.randrange(5000)}" for _ in range(rng.randint(0, 500))] for _ in "ab"]
        rows.append((k, " ".join(around[0] + t + around[1])))
    want = licenses_expected(rows)
    got = {(r.doc_id, r.license, r.template) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got <= want and len(want) > 150
    assert len(want - got) <= 0.01 * len(want)


# 4: urls


def test_urls(spark):
    from topicloom.llm.urls import BLOCK_WORDS, CONTRACT_RULES, url_verdicts, word_rule

    rules = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
    urls = [None, "", "no scheme", "http://x.example.net/en/1", "http://X.Example.NET/en", "http://example.net", "http://net/", "https://a.net?q=/en/", "http://notnet/", "http://planet/", "https://b.example.com/de/x#f", "https://b.example.com/DE/x", "ftp://q.org/fr/a?b", "http://casino-win.example.org/en/1", "http://a/b://c.net/", "http://sub.example.net/en/x/y", "http://é.net/ü", "http://a.net\n/x"]
    rows = [(k, u, "clash", 1) for k, u in enumerate(urls)] + [(3, urls[3], "clash", 1)]
    out = url_verdicts(spark.createDataFrame(rows, "page_id long, url string, host string, _best long"), [*CONTRACT_RULES, *map(word_rule, BLOCK_WORDS)])
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        m = re.search(r"(?s)^.*?://([^/?#]*)([^?#]*)", r.url or "")
        host, path = (fold(m[1]), m[2]) if m else ("", "")
        fit = [(len(x), x, v) for x, v in rules for h, p in [(x[: x.index("/")], x[x.index("/") :])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = (max(fit)[1:]) if fit else (None, "block" if re.search(r"(?:^|[^a-z0-9])casino(?:[^a-z0-9]|$)", host + path) else "allow")
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict), r
    assert url_verdicts(spark.createDataFrame([], "page_id long, url string"), list(CONTRACT_RULES)).count() == 0


def test_rules_without_tokens_and_rivals(spark):
    """Rules without literal tokens are tried on every url; of unnamed rules that
    fit, the first one counts."""
    from topicloom.llm.urls import UrlRule, url_verdicts

    rules = [UrlRule(r"\d{4}", (), "block"), UrlRule("beta", ("beta",), "allow"), UrlRule("alpha", ("alpha",), "block"), UrlRule("^[^/]*alpha", ("alpha",), "named", "alpha"), UrlRule("a.*z", (), "never", None)]
    urls = ["http://x.y/2024", "http://x.y/beta/2024", "http://x.y/alpha/beta", "http://alpha/beta", "http://x.y/none", "http://alpha/z", None]
    got = {r.url: (r.rule, r.verdict) for r in url_verdicts(spark.createDataFrame([(u,) for u in urls], "url string"), rules, default="open").collect()}

    def judged(url):
        m = re.search(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        at = fold(m[1]) + m[2] if m else ""
        fit = [r for r in rules if re.search(r.pattern, at)]
        best = max(fit, key=lambda r: (r.name is not None, len(r.name or ""), -rules.index(r)), default=None)
        return (best.name, best.verdict) if best else (None, "open")

    assert got == {u: judged(u) for u in urls} and {v for _, v in got.values()} == {"block", "allow", "named", "open"}


# 5: lines


def lines_expected(rows, xxhash):
    """Chunks by the same rolling rule, in plain Python."""

    def h64(data, seed=42):
        return xxhash.xxh64_intdigest(data, seed)

    def signed(x):
        return x - (1 << 64) if x >= 1 << 63 else x

    def chunks(text):
        lines, out, now = (text or "").split("\n"), [], []
        hashes = [h64(x.encode()) for x in lines]
        for i, line in enumerate(lines):
            now.append(line)
            roll = 42
            for j in (0, 1):
                if i - j >= 0:
                    roll = h64(int(hashes[i - j]).to_bytes(8, "little"), roll)
            if i == len(lines) - 1 or i >= 1 and signed(roll) % 3 == 0:
                out.append(now)
                now = []
        return out

    first, out = {}, {}
    docs = {r.doc_id: r.text for r in rows}
    for doc in sorted(docs):
        kept, gone = [], 0
        for chunk in chunks(docs[doc]):
            text = "\n".join(chunk)
            if len(chunk) >= 2 and len(text) >= 80 and first.setdefault(text, (doc, len(kept) + gone)) != (doc, len(kept) + gone):
                gone += 1
                continue
            kept.append(chunk)
        out[doc] = ("\n".join(x for c in kept for x in c), gone)
    return docs, out


@pytest.mark.parametrize("few_hashes", [False, True])
def test_chunks(spark, awkward, nothing, scratch, monkeypatch, few_hashes):
    """Chunks by the rolling rule; with hashes that say little, bytes decide alike."""
    xxhash = pytest.importorskip("xxhash")
    from topicloom.llm import lines
    from topicloom.llm.common import Scratch

    if few_hashes:
        monkeypatch.setattr(lines, "_pair", lambda column: [(F.length(column) % 7).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2")])
    extra = spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text")
    extra = extra.union(extra.limit(40).select(F.col("doc_id") + 5000, F.concat(F.lit("A new line in front\n"), "text")))
    docs = awkward.dropDuplicates(["doc_id"]).select("doc_id", "text").union(extra)
    _, want = lines_expected(docs.collect(), xxhash)
    got = Counter(r.doc_id for r in lines.repeated_chunks(docs, scratch).collect())
    assert got == Counter({d: gone for d, (_, gone) in want.items() if gone}) and sum(got.values()) > 20
    out = lines.dedup_passages(awkward, Scratch(spark, "test"))
    assert out.count() == awkward.count() and set(awkward.columns) <= set(out.columns)
    assert lines.dedup_passages(nothing, Scratch(spark, "test")).count() == 0


def passages_expected(rows, min_lines=2, min_chars=80):
    """Kept lines of each document, every run of lines held against all before."""
    seen, out = set(), {}
    for doc, text in sorted((r.doc_id, r.text or "") for r in rows):
        lines, gone = text.split("\n"), set()
        for i in range(len(lines)):
            for j in range(i + min_lines, len(lines) + 1):
                run = "\n".join(lines[i:j])
                if len(run) >= min_chars:
                    gone |= set(range(i, j)) if run in seen else set()
                    seen.add(run)
        out[doc] = [x for k, x in enumerate(lines) if k not in gone]
    return out


def test_repeated_passages(spark, awkward, tmp_path):
    """Passages that documents share go whole, wherever chunks end."""
    import corpus_pipeline
    from topicloom.llm.queries import op5_line_chunks

    rng = random.Random(6)

    def some(n):
        return [" ".join(rng.choice("abcdefghijkl") * rng.randint(1, 9) for _ in range(rng.randint(1, 16))) + (" é" if rng.random() < 0.3 else "") for _ in range(n)]

    made = []
    for k in range(40):
        passage = some(2 + k % 5)
        made += [(2000 + 2 * k + j, "\n".join(some(rng.randint(0, 4)) + passage + some(rng.randint(0, 4)))) for j in (0, 1)]
    extra = spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text")
    docs = awkward.dropDuplicates(["doc_id"]).select("doc_id", "text").union(extra).union(spark.createDataFrame(made, "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = passages_expected(docs.collect())
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = op5_line_chunks(spark, str(tmp_path)).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert r.kept_sha256 == hashlib.sha256("\n".join(want[r.doc_id]).encode()).hexdigest()
        assert r.removed_lines == (0 if texts[r.doc_id] is None else r.n_lines - len(want[r.doc_id])) and r.removed_chunks <= r.n_chunks
    assert sum(r.removed_lines for r in rows if r.doc_id >= 2000) > 80
    whole = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    for r in corpus_pipeline.lines(spark, whole, SF).collect():
        assert (r.text or "") == "\n".join(want[r.doc_id]) and (r.text is None) == (texts[r.doc_id] is None)


# 6: mixing


def test_mixing(spark, awkward, nothing, scratch):
    from topicloom.llm.common import Scratch
    from topicloom.llm.mixing import expand, mix_sources

    rows = [(k, " ".join(["w"] * (5 + k % 7)), "big" if k % 3 else f"small{k % 4}") for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mix_sources(docs, scratch, entropy_gain=0.5, max_repeats=3.0, block_docs=32)
    out = mixed.collect()
    size = Counter()
    for k, t, s in rows:
        size[s] += len(t.split())
    total = sum(size.values())
    w = {r.source: r.weight for r in out}
    passes = {r.source: r.passes for r in out}
    assert len(out) == 900 and abs(sum(w.values()) - 1) < 1e-4
    assert min(passes.values()) == pytest.approx(1) and max(passes.values()) <= 3.001

    def entropy(p):
        return -sum(x * np.log(x) for x in p)

    shares = [x / total for x in size.values()]
    goal = entropy(shares) + 0.5 * (np.log(len(size)) - entropy(shares))
    assert entropy(w.values()) <= goal + 1e-3
    assert entropy(w.values()) == pytest.approx(goal, abs=1e-3) or max(passes.values()) == pytest.approx(3, abs=1e-3)
    spent = defaultdict(int)
    for r in out:
        spent[r.source] += r.copies * r.n_tokens
    for s, n in size.items():
        assert 0 <= spent[s] - passes[s] * n < 12  # at most one document over
    again = {(r.doc_id, r.copies) for r in mix_sources(docs.repartition(7), Scratch(spark, "test"), entropy_gain=0.5, max_repeats=3.0, block_docs=32).collect()}
    assert again == {(r.doc_id, r.copies) for r in out}
    assert expand(docs, mixed, Scratch(spark, "test")).count() == sum(r.copies for r in out)
    assert mix_sources(awkward, Scratch(spark, "test")).count() == awkward.count()
    assert all(r.copies >= 1 for r in mix_sources(awkward, Scratch(spark, "test")).collect())
    assert mix_sources(nothing, Scratch(spark, "test")).count() == 0


# 7: vectors


def links_expected(rows):
    """(labels, links) of (vec_id, embedding, label) rows, pair by pair."""
    def healthy(v):
        return bool(v) and not any(x is None or not np.isfinite(x) for x in v) and any(v)

    def unit(v):
        v = np.array(v, float) / max(map(abs, v))
        return v / np.sqrt(v @ v)

    good = [(k, unit(v), y) for k, v, y in rows if y is not None and healthy(v)]
    return [(a, b) for i, (a, u, x) in enumerate(good) for b, v, y in good[:i] if x == y and len(u) == len(v) and u @ v >= 0.93]


def assert_vectors(got, rows, links):
    of, n = unions([r[0] for r in rows], links), Counter(x for p in links for x in p)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {k: (n[k], of[k], of[k] == k) for k in of}
    assert len(got) == len(rows)


def test_vectors(spark, scratch):
    from topicloom.llm.common import Scratch
    from topicloom.llm.vectors import vector_duplicates

    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 16))
    rows = []
    for k in range(400):
        v = base[k % 12] + rng.normal(scale=0.25, size=16)
        rows.append((k, [float(x) for x in v.astype(np.float32)], int(k % 2)))
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] + [1.0] * 15, 1), (403, rows[5][1], 1), (404, rows[5][1], None), (405, [None] + [1.0] * 15, 0), (406, [1.0, 2.0], 0), (407, [2.0, 4.0], 0), (408, [], 0)]
    links = links_expected(rows)
    assert len(links) > 300
    table = spark.createDataFrame([(*r, 0, "k") for r in rows], "vec_id long, embedding array<float>, label int, copies long, dim string")
    assert_vectors(vector_duplicates(table, scratch, list_rows=50).collect(), rows, links)
    assert vector_duplicates(table.where("false"), Scratch(spark, "test")).count() == 0


def test_vectors_in_double_precision(spark, scratch):
    """Numbers that have no single-precision form, and rows that repeat an id."""
    from topicloom.llm.common import Scratch
    from topicloom.llm.vectors import vector_duplicates

    rows = [(1, [1.0, 2.0], 0), (2, [1.0, 1.0], 0), (3, [1e-50, 2e-50], 0), (4, [1e300, 1e300], 0), (5, [1e-200, -1e-200], 0), (6, [float("inf"), 1.0], 0), (7, [1.0, 1.0], 1), (8, [3e-320, 1e-310], 2)]
    schema = "vec_id long, embedding array<double>, label int"
    assert_vectors(vector_duplicates(spark.createDataFrame(rows, schema), scratch).collect(), rows, links_expected(rows))
    twice = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [0.0, 1.0], 0)], schema)
    got = sorted(tuple(r) for r in vector_duplicates(twice, Scratch(spark, "test")).collect())
    assert got == [(1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False)]


def test_vectors_against_sql(spark, tmp_path):
    """Hundreds of links, the query and its SQL on one table."""
    duckdb = pytest.importorskip("duckdb")
    from topicloom.llm.queries import OP7_SQL, op7_pq_dedup

    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 24))
    near = x[rng.integers(0, 200, 300)] + rng.normal(scale=0.22, size=(300, 24))
    made = [(k, [float(c) for c in v.astype(np.float32)], int(k % 3 == 0)) for k, v in enumerate(np.concatenate((x, near)))]
    spark.createDataFrame(made, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(f"SELECT vec_id, n_links, component_id, kept FROM ({OP7_SQL})").fetchall()
    assert sorted(tuple(r) for r in op7_pq_dedup(spark, str(tmp_path)).collect()) == sorted(want)
    assert sum(r[1] for r in want) > 300


def test_vectors_where_lists_outnumber_probes(spark, scratch):
    from topicloom.llm.vectors import Quantiser, unit, vector_duplicates

    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 32))
    y = rng.normal(size=(600, 32))
    u = unit(x[:600])
    y = unit(y - (unit(y) * u).sum(1)[:, None] * u * np.sqrt((y * y).sum(1))[:, None])
    c = rng.uniform(0.931, 0.97, 600)[:, None]
    every = np.concatenate((x, c * u + np.sqrt(1 - c * c) * y))
    model = Quantiser(every, 30, 8, 64)
    near = model.probes(unit(every), 900)
    assert len(np.unique(near[:, 0])) > 300 and (np.sort(near, 1) == np.arange(900)).all()
    rows = [(k, [float(z) for z in v], 0) for k, v in enumerate(every)]
    links = links_expected(rows)
    got = vector_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), scratch, list_rows=4, probes=32).collect()
    found, asked = sum(r.n_links for r in got), 2 * len(links)
    assert len(links) >= 590 and 0.97 * asked <= found <= asked


def test_samples_are_bounded(spark, scratch):
    """However many tasks there are, no more rows reach the driver."""
    from topicloom.llm.vectors import fitted

    reps = spark.range(30000, numPartitions=64).select("id", F.array(F.rand(1), F.rand(2)).alias("embedding"), F.lit(2).alias("dim"))
    plan = fitted(reps, 500, 1000, 2, 16)
    assert len(plan[2].books[0]) == 16


# 8: quality


def stats_expected(text):
    w = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    many, covered = Counter(runs), set()
    for i, r in enumerate(runs):
        if many[r] > 1:
            covered.update(range(i, i + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality(spark, awkward, nothing, scratch):
    from topicloom.llm.common import Scratch
    from topicloom.llm.quality import STATS, quality_rules

    docs = awkward.select("doc_id", "text").union(spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id") + 100, "text"))
    labels = spark.read.parquet(f"{SF}/labels.parquet").withColumn("doc_id", F.col("doc_id") + 100)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = quality_rules(docs, labels, scratch).collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = stats_expected(texts[r.doc_id])
        assert tuple(r[k] for k in STATS) == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r.base_failed == failed and not (failed and r.kept)
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    judged = [r for r in rows if r.doc_id in good and not r.base_failed]
    assert sum(r.kept for r in judged) >= 0.97 * len(judged)
    assert quality_rules(awkward, labels, Scratch(spark, "test")).count() == awkward.count()
    assert quality_rules(nothing, labels, Scratch(spark, "test")).count() == 0
    assert quality_rules(awkward, labels.where("false"), Scratch(spark, "test")).count() == awkward.count()


def test_forest_on_held_out_labels(spark, scratch):
    """Fitted on even ids, judged on odd ones: bad documents go, good ones stay."""
    from topicloom.llm.quality import quality_rules

    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    judged = quality_rules(spark.read.parquet(f"{sf}/documents.parquet"), labels.where("doc_id % 2 = 0"), scratch).where("not base_failed")
    held = judged.join(labels.where("doc_id % 2 = 1"), "doc_id").groupBy("quality").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("kept")).collect()
    good, bad = next(r for r in held if r.quality == 1), next(r for r in held if r.quality == 0)
    assert bad.n > 100 and bad.kept <= 0.1 * bad.n
    assert good.n > 1000 and good.kept >= 0.998 * good.n


def test_labelled_rows_are_bounded(spark, scratch):
    from topicloom.llm.common import Scratch
    from topicloom.llm.quality import fit_forest, rule_stats

    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), 30 + F.col("id") % 50), lambda k: (k * (F.col("id") + 3) % 1009).cast("string")))
    docs = spark.range(4000, numPartitions=32).select(F.col("id").alias("doc_id"), text.alias("text"))
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 9 == 0, 0).otherwise(1).alias("quality"))
    stats = rule_stats(docs)
    few = fit_forest(stats, labels, scratch, labelled_rows=200, tree_rows=256)
    assert 100 < few["size"] <= 200
    assert fit_forest(stats.repartition(5), labels, Scratch(spark, "test"), labelled_rows=200) == few


def test_forest_finds_anomalies():
    from topicloom.llm.quality import anomaly_score, grow_tree

    rng = np.random.default_rng(0)
    rows = rng.normal(size=(2000, 3))
    forest = [grow_tree(rows[rng.choice(2000, 256, replace=False)], rng, 0, 8) for _ in range(50)]
    near, far = anomaly_score(forest, rows[:500], 256), anomaly_score(forest, rng.normal(size=(50, 3)) + 8, 256)
    assert far.min() > np.quantile(near, 0.99)


# 9: suffix arrays


def test_suffix_arrays():
    from topicloom.llm.suffix import suffix_arrays

    rng = np.random.default_rng(5)
    for _ in range(150):
        lanes = [rng.integers(0, rng.integers(1, 5), rng.integers(0, 40)) for _ in range(rng.integers(1, 9))]
        starts = np.cumsum([0, *(len(x) + 1 for x in lanes)])
        symbols = np.concatenate([np.append(x + 1, -1) for x in lanes])
        sa = suffix_arrays(symbols, starts)
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            x = symbols[a:b].tolist()
            assert (sa[a:b] - a).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


def bytes_expected(rows, length):
    seen, out = set(), {}
    for doc, text in sorted((r.doc_id, r.text or "") for r in rows):
        b = text.encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        gone = gone[:-1]
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[doc] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_bytes(spark, awkward, nothing, scratch):
    from topicloom.llm.common import Scratch
    from topicloom.llm.suffix import dedup_bytes

    rng = random.Random(2)
    shared = "".join(rng.choice("abcde ") for _ in range(400))
    made = [(200 + k, "".join(rng.choice("abcde ") for _ in range(rng.randint(0, 300))) + shared[rng.randint(0, 200) : rng.randint(201, 400)] * rng.randint(0, 2) + "é" * rng.randint(0, 150)) for k in range(80)]
    docs = awkward.dropDuplicates(["doc_id"]).select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string"))
    want = bytes_expected(docs.collect(), 100)
    out = dedup_bytes(docs, scratch).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha")).collect()
    assert {r.doc_id: tuple(r)[1:] for r in out} == want
    assert sum(x[1] for x in want.values()) > 1000
    salted = dedup_bytes(docs, Scratch(spark, "test"), lane_contexts=2).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha")).collect()
    assert {r.doc_id: tuple(r)[1:] for r in salted} == want
    assert dedup_bytes(nothing, Scratch(spark, "test")).count() == 0
    assert dedup_bytes(awkward, Scratch(spark, "test")).count() == awkward.count()


def test_long_texts_in_segments(monkeypatch):
    from topicloom.llm import suffix

    rng = np.random.default_rng(1)
    raw = rng.integers(97, 100, 5000).astype(np.uint8)
    monkeypatch.setattr(suffix, "SEGMENT", 700)
    doc, start, windows, h, place = suffix.window_runs(raw, np.array([0, len(raw)]), 100)
    covered = np.zeros(len(raw), int)
    for s, n in zip(start, windows, strict=True):
        covered[s : s + n] += 1
    assert (covered[: len(raw) - 99] == 1).all() and not covered[len(raw) - 99 :].any()


# 10: packing


def test_packing(spark, awkward, nothing, scratch, tokenizers):
    from topicloom.llm.common import Scratch
    from topicloom.llm.packing import pack

    path, library = tokenizers["word_bpe_49k.json"]
    extra = spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") + 100).alias("doc_id"), "text")
    docs = awkward.dropDuplicates(["doc_id"]).select("doc_id", "text").union(extra)
    rows = pack(docs, scratch, path, shard_tokens=20000).collect()
    ids = {r.doc_id: np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in docs.collect()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc, x in ids.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.length > 0
            at += r.length
        assert at == len(x)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0
    assert pack(nothing, Scratch(spark, "test"), path).count() == 0
    repeated = pack(awkward, Scratch(spark, "test"), path).collect()
    assert sum(r.length for r in repeated) == sum(len(ids[r.doc_id]) for r in awkward.collect())


def bm25(ids):
    """Scores of every document (column) for the terms of every other (row)."""
    n, tf = len(ids), [Counter(x) for x in ids]
    df, mean = Counter(t for c in tf for t in c), sum(map(len, ids)) / len(ids)
    idf = {t: np.log((n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
    out = np.zeros((n, n))
    for j, c in enumerate(tf):
        w = {t: idf[t] * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(ids[j]) / mean)) for t, f in c.items() if idf[t] > 0}
        for i in range(n):
            out[i, j] = sum(w.get(t, 0) for t in tf[i])
    return out


def test_dealing_in_two_levels():
    """More shards than a level has centres: alike vectors still meet."""
    from topicloom.llm import packing

    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, packing.DIMENSIONS))
    x = (base[rng.integers(0, 300, 6000)] + 0.3 * rng.normal(size=(6000, packing.DIMENSIONS))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    was, packing.CENTRES = packing.CENTRES, 16
    try:
        deal = packing.Dealer(x[:3000], np.ones(3000), 100)
    finally:
        packing.CENTRES = was
    of = deal(x)
    assert [len(p) for _, p in deal.levels] == [16, 7] and 60 < len(np.unique(of)) <= 112
    near = (x @ x.T - 2 * np.eye(6000)).argmax(1)
    assert (of == of[near]).mean() > 0.5 and np.bincount(of).max() < 1200


def test_neighbours_share_a_shard(spark, scratch, tokenizers):
    from topicloom.llm.packing import NUMBER_BITS, pack

    path, library = tokenizers["word_bpe_49k.json"]
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    topics = [["".join(rng.choice(letters) for _ in range(7)) for _ in range(40)] for _ in range(24)]
    common = ["".join(rng.choice(letters) for _ in range(5)) for _ in range(60)]
    texts = [" ".join(rng.choices(topics[k % 24], k=40) + rng.choices(common, k=40)) for k in range(240)]
    ids = [[*library.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    score = bm25(ids)
    np.fill_diagonal(score, -1)
    rows = pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), scratch, path, shard_tokens=sum(map(len, ids)) // 8).collect()
    shard = {r.doc_id: (r.sequence_id - (1 << 62)) >> NUMBER_BITS for r in rows}
    assert len(set(shard.values())) >= 4
    assert np.mean([shard[int(score[k].argmax())] == shard[k] for k in range(240)]) > 0.8


def test_packed_neighbours_score_above_random(spark, scratch, tokenizers):
    """Documents that share a window are more alike than documents at random."""
    from topicloom.llm.packing import pack

    path, library = tokenizers["word_bpe_49k.json"]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) between 400 and 3000").orderBy("doc_id").limit(240).collect()]
    ids = [[*library.encode(t, add_special_tokens=False).ids, 1] for _, t in rows]
    score = bm25(ids)
    np.fill_diagonal(score, np.nan)
    at = {d: k for k, (d, _) in enumerate(rows)}
    packed = defaultdict(list)
    for r in pack(spark.createDataFrame(rows, "doc_id long, text string"), scratch, path, shard_tokens=sum(map(len, ids)) // 5).collect():
        packed[r.sequence_id].append((r.offset, at[r.doc_id]))
    together = [score[a, b] for x in packed.values() for (_, a), *rest in [sorted(x)] for _, b in rest if a != b]
    assert len(together) > 50 and np.mean(together) > 1.5 * np.nanmean(score)


def test_all_terms_of_a_seed_count(spark, scratch, tokenizers):
    """A neighbour that shares none of the seed's rarest words is found."""
    from topicloom.llm.packing import Index, pack

    path, library = tokenizers["word_bpe_49k.json"]
    words = [w for w in sorted(x.strip("Ġ▁") for x in library.get_vocab()) if re.fullmatch("[a-z]{4,9}", w)]
    words = [w for w in dict.fromkeys(words) if len(library.encode("a " + w, add_special_tokens=False).ids) == len(library.encode("a", add_special_tokens=False).ids) + 1][:900]
    assert len(words) == 900
    rare, shared, other = words[:80], words[80:140], words[140:]
    fillers = [" ".join(other[40 * k : 40 * k + 110]) for k in range(12)]
    texts = [" ".join(rare + shared), " ".join(shared), *fillers]
    rows = pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), scratch, path).collect()
    first = {r.sequence_id: r for r in rows if r.offset == 0}
    seed = next(r for r in rows if r.doc_id == 0)
    assert first[seed.sequence_id].doc_id == 0
    line = sorted((r.sequence_id, r.offset, r.doc_id) for r in rows)
    assert line[line.index((seed.sequence_id, 0, 0)) + 1][2] == 1

    rng = np.random.default_rng(2)
    docs = [np.minimum(rng.zipf(1.3, rng.integers(1, 400)), 3000).astype("<u2") for _ in range(60)]
    df = Counter(t for x in docs for t in set(x.tolist()))
    idf = np.zeros(3001)
    for t, d in df.items():
        idf[t] = np.log((60 - d + 0.5) / (d + 0.5))
    index, want = Index(docs, idf, sum(map(len, docs)) / 60), bm25([x.tolist() for x in docs])
    for k in range(60):
        assert np.allclose(index.scores(k), want[k])


def test_neighbours_are_alike(tokenizers):
    from topicloom.llm.packing import Index

    rng = np.random.default_rng(0)
    docs = [rng.integers(1000 * (k % 4), 1000 * (k % 4) + 300, 200).astype("<u2") for k in range(40)]
    index = Index(docs, np.full(5000, 2.0), 200.0, 24)
    best = np.argsort(-index.scores(0))[1:10]
    assert all(k % 4 == 0 for k in best)


# the pipeline


def test_pipeline(spark):
    import corpus_pipeline
    from topicloom.llm.common import Scratch

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scratch, before = Scratch(spark, "test"), docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = scratch.keep(stage(spark, before, SF), name)
        assert after.columns == docs.columns
        assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    totals = {r.doc_id for r in last.select("doc_id").distinct().collect()}
    assert totals == {r.doc_id for r in before.select("doc_id").distinct().collect()}
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near", "mixing", "packing"]


def test_pipeline_rows_without_unique_ids(spark):
    """Rows, not ids, are dropped."""
    import corpus_pipeline

    rng = random.Random(12)

    def prose(n=60):
        return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n))

    a, b, c, d = (prose() for _ in range(4))
    rows = [(None, "too short"), (None, a), (1, a), (2, b), (2, "short as well"), (3, c), (3, c), (None, d), (None, d)]
    base = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").limit(60).select((F.col("doc_id") + 1000).alias("doc_id"), *corpus_pipeline.COLUMNS[1:])
    made = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], base.schema)
    judged = {(r.doc_id, r.text) for r in corpus_pipeline.quality(spark, base.union(made), SF).collect()}
    assert not {(None, "too short"), (2, "short as well")} & judged
    near = Counter((r.doc_id, r.text) for r in corpus_pipeline.near(spark, made, SF).collect() if len(r.text) > 20)
    assert near == Counter([(1, a), (2, b), (3, c), (None, d)])


def test_pipeline_stages_on_awkward_rows(spark, awkward, nothing, tokenizers):
    """Nulls, empty and long texts, ties, repeated rows, clashing columns, and
    nothing at all, through each stage."""
    import corpus_pipeline

    library = tokenizers["word_bpe_49k.json"][1]
    stages, columns = dict(corpus_pipeline.STAGES), corpus_pipeline.COLUMNS
    docs = awkward.union(awkward.where("doc_id in (2, 6)").withColumn("doc_id", F.lit(None).cast("long")))
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]

    def after(name):
        out = stages[name](spark, docs, SF)
        assert out.columns == columns
        return out.collect()

    stats = [stats_expected(t) for _, t, _ in rows]
    good = Counter((d, t) for (d, t, _), s in zip(rows, stats, strict=True) if s[0] >= 20 and 100 * s[4] <= 30 * s[0])
    kept = Counter((r.doc_id, r.text) for r in after("quality"))
    assert not kept - good and kept[6, rows[6][1]] == 1

    texts = after("lines")
    assert len(texts) == len(rows) and sum(r.text is None for r in texts) == sum(t is None for _, t, _ in rows)
    assert all(r.n_chars == len(r.text or "") for r in texts)

    near = after("near")
    wordless = [t for _, t, _ in rows if not WORD.search(t or "")]
    assert sorted(map(str, (r.text for r in near if not WORD.search(r.text or "")))) == sorted(map(str, wordless))
    sets = [shingles(t) for _, t, _ in rows if WORD.search(t or "")]
    assert len([r for r in near if WORD.search(r.text or "")]) == len({min(k for k, y in enumerate(sets) if 100 * len(x & y) >= 75 * len(x | y)) for x in sets})

    mixed = Counter((r.doc_id, r.text, r.source) for r in after("mixing"))
    assert all(mixed[x] >= n for x, n in Counter(rows).items()) and set(mixed) == set(rows)

    pieces = stages["packing"](spark, docs, SF).collect()
    assert sum(r.length for r in pieces) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in rows)
    for name in stages:
        assert stages[name](spark, nothing, SF).count() == 0


def test_pipeline_stages_by_brute_force(spark, scratch, tokenizers):
    import corpus_pipeline

    library = tokenizers["word_bpe_49k.json"][1]
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")

    def step(name, before):
        after = scratch.keep(stages[name](spark, before, SF), name)
        return after, after.collect()

    start = docs.collect()
    now, rows = step("quality", docs)
    texts, kept = {r.doc_id: r.text for r in start}, {r.doc_id for r in rows}
    assert all(r.text == texts[r.doc_id] for r in rows) and len(rows) == len(kept)
    stats = {k: stats_expected(t) for k, t in texts.items()}
    failed = {k for k, s in stats.items() if s[0] < 20 or 100 * s[4] > 30 * s[0]}
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()} - failed
    assert failed and not kept & failed and len(kept & good) >= 0.97 * len(good)

    want = passages_expected(rows)
    now, rows = step("lines", now)
    assert {r.doc_id: r.text or "" for r in rows} == {k: "\n".join(x) for k, x in want.items()}
    assert all(r.n_chars == len(r.text) for r in rows if r.text != texts[r.doc_id])

    of, before = near_expected(rows)[1], {r.doc_id: r.text for r in rows}
    now, rows = step("near", now)
    assert {r.doc_id: r.text for r in rows} == {k: t for k, t in before.items() if of[k] == k}

    from topicloom.llm.common import Scratch
    from topicloom.llm.mixing import mix_sources

    copies, before = {r.doc_id: r.copies for r in mix_sources(now, Scratch(spark, "test")).collect()}, {r.doc_id: r.text for r in rows}
    now, rows = step("mixing", now)
    assert Counter((r.doc_id, r.text) for r in rows) == Counter({(k, before[k]): n for k, n in copies.items()}) and set(copies) == set(before)

    ids = {k: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for k, t in before.items()}
    pieces, covered = step("packing", now)[1], defaultdict(Counter)
    for r in pieces:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        covered[r.doc_id].update(range(r.start, r.start + r.length))
    assert all(covered[k] == Counter(dict.fromkeys(range(len(x)), copies[k])) for k, x in ids.items())


def test_rows_that_repeat_an_id(spark, scratch):
    """Each row is a document: nothing unique goes, nothing crashes."""
    from topicloom.llm.common import Scratch
    from topicloom.llm.lines import dedup_passages
    from topicloom.llm.mixing import expand, mix_sources
    from topicloom.llm.near import near_duplicates
    from topicloom.llm.suffix import dedup_bytes

    rng = random.Random(4)

    def prose(n, sep=" "):
        return sep.join(" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(12)) for _ in range(n))

    def table(*rows):
        return spark.createDataFrame(list(rows), "doc_id long, text string")

    a, b = prose(20), prose(20)
    got = Counter((r.doc_id, r.component_id, r.kept) for r in near_duplicates(table((0, a), (1, a), (1, b)), scratch).collect())
    assert got == Counter([(0, 0, True), (1, 0, False), (1, 1, True)])

    x, y = prose(20, "\n"), prose(20, "\n")
    kept = {r.text for r in dedup_passages(table((0, x), (1, x), (1, y)), Scratch(spark, "test")).collect()}
    assert kept == {x, "", y}

    long = prose(30)
    for rows in (((0, long), (1, long + " " + long), (1, "short")), ((0, long), (1, long + " " + long), (1, b))):
        want = [long, rows[2][1]]
        held = sorted((bytes(r.kept).decode() for r in dedup_bytes(table(*rows), Scratch(spark, "test")).collect()), key=len)
        assert all(w in held for w in want) and len(held) == 3 and len(held[0]) <= 6

    docs = spark.createDataFrame([(1, a, "s"), (1, b, "s"), (1, a, "t"), (2, prose(3), "t"), (3, a, "s"), (3, a, "s"), (None, b, "t"), (None, b, "t"), (None, a, None)], "doc_id long, text string, source string")
    mixed = mix_sources(docs, Scratch(spark, "test"), max_repeats=5.0)
    out = expand(docs, mixed, Scratch(spark, "test"))
    assert mixed.count() == 9 and out.count() == mixed.agg(F.sum("copies")).first()[0]
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in docs.collect()}


def test_null_ids(spark, awkward, tokenizers):
    """Rows without an id crash nothing and keep their place in the results."""
    from topicloom.llm.common import Scratch
    from topicloom.llm.licenses import scan_licenses
    from topicloom.llm.lines import dedup_passages
    from topicloom.llm.mixing import mix_sources
    from topicloom.llm.near import near_duplicates
    from topicloom.llm.packing import pack
    from topicloom.llm.quality import quality_rules
    from topicloom.llm.suffix import dedup_bytes
    from topicloom.llm.tokens import digest, read_orc, write_orc
    from topicloom.llm.vectors import vector_duplicates

    docs = awkward.union(awkward.withColumn("doc_id", F.lit(None).cast("long")))
    n = docs.count()
    scratch = Scratch(spark, "test")
    write_orc(docs, scratch.path("t"), tokenizers["byte_bpe_50k.json"][0], 0)
    assert digest(read_orc(spark, scratch.path("t"))).count() == n
    assert near_duplicates(docs, Scratch(spark, "test")).count() == n
    assert dedup_passages(docs, Scratch(spark, "test")).count() == n
    assert mix_sources(docs, Scratch(spark, "test")).count() == n
    assert quality_rules(docs, spark.read.parquet(f"{SF}/labels.parquet"), Scratch(spark, "test")).count() == n
    assert dedup_bytes(docs, Scratch(spark, "test")).count() == n
    assert scan_licenses(docs).where("doc_id is null").count() == 1
    pieces = pack(docs, Scratch(spark, "test"), tokenizers["word_bpe_49k.json"][0])
    assert pieces.agg(F.sum("length")).first()[0] == 2 * pack(awkward, Scratch(spark, "test"), tokenizers["word_bpe_49k.json"][0]).agg(F.sum("length")).first()[0]
    vectors = spark.createDataFrame([(1, [1.0, 2.0], 0), (None, [1.0, 2.0], 0), (2, [1.0, 2.1], 0), (None, None, None)], "vec_id long, embedding array<float>, label int")
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in vector_duplicates(vectors, Scratch(spark, "test")).collect()), key=str)
    assert got == [(0, 0, None, True), (0, 0, None, True), (1, 1, 1, True), (2, 1, 1, False)]


def test_packing_of_very_many_tiny_rests():
    """Rests without a term go by their place, and neighbours by one partial sort, so
    time grows with the rests."""
    import time

    from topicloom.llm.packing import pack_shard

    kind, idf = np.dtype(np.uint16), np.array([0.0, -1.0, 2.0])
    took = []
    for n in (20000, 160000):
        rows = [(k, 0, 1, np.array([1 + (k % 1000 == 0)], kind).tobytes()) for k in range(n)]
        began = time.process_time()
        pieces = pack_shard(3, rows, idf, 1.0, 2048, None, kind)
        took.append(time.process_time() - began)
        assert sorted(p[0] for p in pieces) == list(range(n)) and {p[2] for p in pieces} == {1}
        assert len({p[5] for p in pieces}) <= n // 2048 + 11
    assert took[1] < 20 * took[0]
    first = {p[0] for p in pieces if p[5] == pieces[0][5]}
    assert {k for k in range(n) if k % 1000 == 0} <= first or len(first) == 2048  # those that share the seed's term come first


def test_line_dedup_joins_alike_at_every_size(spark):
    """Small tables are not broadcast, so what moves grows with the input, not faster."""
    from topicloom.llm import lines
    from topicloom.llm.common import Scratch

    docs = spark.createDataFrame([(k, "\n".join([f"{'a' * 60} one", f"{'b' * 60} two", f"last {k % 2}"])) for k in range(4)], "doc_id long, text string")
    scratch = Scratch(spark, "lines")
    again = lines.repeated_chunks(docs, scratch)
    cut = scratch.keep(again.groupBy("doc_id").agg(F.collect_list(F.struct("b", "n")).alias("cut")), "cut")
    for out in (again, lines.repeated_runs(docs, cut, scratch), lines.dedup_passages(docs, Scratch(spark, "passages"))):
        assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
