"""python -m topicloom COMMAND ARGUMENTS [--name=value ...]

gibbs|filter PATH [CATEGORIES]        learn from a labelled corpus
batch PATH                            learn from an unlabelled corpus
seeds PATH CATEGORIES TRIES           rank seeds by their initial runs
newsgroups TRAIN TEST OUT             [--stop_list= --tokenizer= --lower= --remove_header= --remove_walls=]
tweets|newswire IN OUT                [--stop_list= --train_frac= --seed=; newswire: --tokenizer= --lower=]
annotate|flatten IN OUT               a labelled corpus to annotated documents and back [--format=binary|compact|json; flatten: --stop_list= --lower=]
generate OUT                          [--num_docs= --num_words= --num_topics= --vocab_size= --alpha= --beta= --train_frac= --seed=]
traces LOGS OUT                       tables of metrics [--iter_key=doc]
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions.text import categories
from topicloom.operators.trace import process_logs
from topicloom.plans import runs
from topicloom.plans.params import _parsed
from topicloom.sources import corpus as S
from topicloom.sources.thrift import read_documents, write_documents


def _options(given: dict[str, str], **defaults: object) -> dict:
    if unknown := sorted(set(given) - set(defaults)):
        raise ValueError(f"unknown options: {', '.join(unknown)}")
    return defaults | {k: _parsed(v, defaults[k]) for k, v in given.items()}


def _stop(spark: SparkSession, path: str) -> list[str]:
    return sorted(r.word for r in S.read_stop_list(spark, path).collect()) if path else []  # a parameter


def _read(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    return S.read_labelled(spark, path, categories(names[0]) if names else None)


def learn(run: Callable[..., runs.Run]) -> Callable:
    def command(spark: SparkSession, given: dict[str, str], path: str, *names: str) -> None:
        docs = S.read_unlabelled(spark, path) if run is runs.run_batch else _read(spark, path, list(names))
        found = run(docs, **given)
        print(f"seed: {found.seed}")
        at = None
        for r in found.metrics.orderBy("iter", "metric").collect():
            if r.iter != at:
                at = r.iter
                print(f"{'doc' if run is runs.run_filter else 'iter'}: {at}")
            print(f"{r.metric.replace('_', ' ')}: {r.value}")
        last = found.topics.agg(F.max("iter")).first()[0]
        for r in found.topics.where(F.col("iter") == last).orderBy("topic", "rank").collect():
            print(f"topic {r.topic}, {r.rank}: {r.word} {r.n}")
        if found.dump is not None:
            for r in found.dump.orderBy("kind", "particle", "topic", "word_id", "doc_id").collect():
                print(" ".join(str(x) for x in r if x is not None))

    return command


def seeds(spark: SparkSession, given: dict[str, str], path: str, subset: str, tries: str) -> None:
    for r in runs.find_seeds(_read(spark, path, [subset]), int(tries), **given).orderBy("rank").collect():
        print(f"{r.rank}: seed {r.seed}, nmi {r.score}")


def newsgroups(spark: SparkSession, given: dict[str, str], train: str, test: str, out: str) -> None:
    o = _options(given, stop_list="", tokenizer="nonalpha", lower=False, remove_header=False, remove_walls=False)
    o["stop"] = _stop(spark, o.pop("stop_list"))
    parts = [S.transform_newsgroups(S.read_newsgroup_tree(spark, path, split), ["file"], **o) for path, split in ((train, "train"), (test, "test"))]
    S.write_labelled_text(parts[0].union(parts[1]), out)


def tweets(spark: SparkSession, given: dict[str, str], source: str, out: str) -> None:
    o = _options(given, stop_list="", train_frac=0.6, seed=0)
    rows = S.visible_lines(spark, source).withColumn("line", F.monotonically_increasing_id())
    S.write_labelled_text(S.transform_tweets(S.numbered(rows, ["file", "line"]), "doc_id", "value", o["train_frac"], _stop(spark, o["stop_list"]), o["seed"]), out)


def newswire(spark: SparkSession, given: dict[str, str], source: str, out: str) -> None:
    o = _options(given, stop_list="", train_frac=0.8, tokenizer="nonalpha", lower=False, seed=0)
    o["stop"] = _stop(spark, o.pop("stop_list"))
    S.write_labelled_text(S.transform_newswire(S.read_newswire(spark, source), "file_no", place="doc_no", **o), out)


def annotate(spark: SparkSession, given: dict[str, str], source: str, out: str) -> None:
    o = _options(given, format="binary")
    docs = S.read_labelled(spark, source)
    if o["format"] == "json":
        S.write_annotated(docs, out)
    else:
        write_documents(S.annotate(docs), out, o["format"])


def flatten(spark: SparkSession, given: dict[str, str], source: str, out: str) -> None:
    o = _options(given, stop_list="", lower=False, format="binary")
    how = {"lower": o["lower"], "stop": _stop(spark, o["stop_list"])}
    docs = S.read_annotated(spark, source, **how) if o["format"] == "json" else S.flatten_annotated(read_documents(spark, source, o["format"]), **how)
    S.write_labelled_text(docs, out)


def generate(spark: SparkSession, given: dict[str, str], out: str) -> None:
    o = _options(given, num_docs=2000, num_words=100, num_topics=10, vocab_size=100, alpha=0.1, beta=0.1, train_frac=0.6, seed=0)
    S.write_labelled_text(S.generate_corpus(spark, **o), out)


def traces(spark: SparkSession, given: dict[str, str], source: str, out: str) -> None:
    for dataset, logs in process_logs(spark, source, out, **_options(given, iter_key="doc")).items():
        print(f"{dataset}: {len(logs)} runs")


COMMANDS = {"gibbs": learn(runs.run_gibbs), "filter": learn(runs.run_filter), "batch": learn(runs.run_batch), "seeds": seeds, "newsgroups": newsgroups, "tweets": tweets, "newswire": newswire, "annotate": annotate, "flatten": flatten, "generate": generate, "traces": traces}


def main(args: list[str]) -> int:
    plain = [a for a in args if not (a.startswith("--") and "=" in a)]
    given = dict(a[2:].split("=", 1) for a in args if a.startswith("--") and "=" in a)
    least = {"seeds": 3, "newsgroups": 3, "gibbs": 1, "filter": 1, "batch": 1, "generate": 1}
    if not plain or plain[0] not in COMMANDS or len(plain) - 1 < least.get(plain[0], 2):
        print(__doc__)
        return 2
    COMMANDS[plain[0]](SparkSession.builder.appName("topicloom").getOrCreate(), given, *plain[1:])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
