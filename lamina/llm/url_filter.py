"""URL filters: host and path rules, then words and naive Bayes.

Concatenated names are split into words by a unigram Viterbi search; a multinomial naive Bayes model
over the words of host and path then scores the url. The unigram model counts, over all urls, in how
many different hosts a word stands by itself, in the host or a path, so that no single host makes a
word; it keeps a bounded number of the most frequent. Two general lists of words, which also count as
words of the language, say what the classes are; what other words say of them is learned from all hosts
by expectation-maximisation: hosts are weighed by the words that are known so far, and words counted by
these weights. Judging is a map over urls without shuffle.
"""

from __future__ import annotations

import copy
import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_position, by_value, received, released, stored

#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))

# Words of unwanted and of wanted sites, which train the classes.
BLOCKED = """
casino poker bet bets betting gamble gambling slots jackpot roulette lottery bingo blackjack odds
pills pharmacy viagra cialis drugs meds steroids prescription diet miracle
porn sex xxx adult nude escort escorts cams erotic fetish hookup singles dating
spam phishing malware virus trojan hack hacked crack cracked warez keygen torrent pirated
ad ads adserver tracker tracking popup popups banner banners click clicks clickbait affiliate
loan loans payday cash rich earn profit prize prizes winner claim bonus free win cheap discount
replica fake counterfeit followers likes
""".split()
ALLOWED = """
news journal magazine article story report archive library museum university school college
science research history language dictionary encyclopedia wiki education learning lecture
health hospital public service weather city local community forum help support
home garden recipes kitchen food family travel guide park nature
music theatre art film photo gallery book books poem review
software source docs code data project developer
sports club football world economy government law office
""".split()
#: Words of urls of either class; both classes have seen them.
NEUTRAL = "www m blog mobile web page html index example com net org co info en de fr es it lang the of and in".split()
#: Prior share of blocked urls, and what is added to each count (Lidstone).
PRIOR, SMOOTHING = 0.3, 0.1
#: A word of the data stands in so many different hosts; the most frequent so many are kept (some 3 MB, broadcast).
LEAST_HOSTS, VOCABULARY = 3, 50_000
#: Rounds of expectation-maximisation, and the words of each class, spread as over all hosts, that are added to what it counts: a few hosts alone teach little.
ROUNDS, SHRINK = 6, 100.0
_LONGEST = 20


class WordModel:
    """Unigram log-probabilities; an unknown word costs more with each letter."""

    def __init__(self, counts: Mapping[str, int]) -> None:
        self.total = sum(counts.values())
        self.logp = {w: math.log(n / self.total) for w, n in counts.items()}

    def cost(self, word: str) -> float:
        return self.logp.get(word, -math.log(self.total) - 2.3 * len(word))

    def split(self, name: str) -> list[str]:
        """The likeliest words; of equally likely splits that with the longer last word. Unknown letters in a row are one word."""
        best, cut = [0.0], [0]
        for j in range(1, len(name) + 1):
            # a word longer than the window can only be unknown, and then is the sum of its parts
            score, i = max((best[i] + self.cost(name[i:j]), -i) for i in range(max(0, j - _LONGEST), j))
            best.append(score)
            cut.append(-i)
        words, j = [], len(name)
        while j:
            word = name[cut[j] : j]
            if words and word not in self.logp and words[-1] not in self.logp:
                words[-1] = word + words[-1]
            else:
                words.append(word)
            j = cut[j]
        return words[::-1]


class UrlModel:
    """counts: hosts of each word of the data, as word_counts() gives them. A listed word counts as one host more; what it says is given by the lists, what others say by learn()."""

    def __init__(self, counts: Mapping[str, int] | None = None, blocked: Sequence[str] = BLOCKED, allowed: Sequence[str] = ALLOWED, prior: float = PRIOR) -> None:
        self.words = WordModel(Counter(counts or {}) + Counter({*blocked, *allowed, *NEUTRAL}))
        in_blocked, in_allowed = Counter([*blocked, *NEUTRAL]), Counter([*allowed, *NEUTRAL])
        size = SMOOTHING * len(set(in_blocked) | set(in_allowed))
        nb, na = sum(in_blocked.values()) + size, sum(in_allowed.values()) + size
        self.odds = {w: math.log((in_blocked[w] + SMOOTHING) / nb) - math.log((in_allowed[w] + SMOOTHING) / na) for w in {*in_blocked, *in_allowed}}
        self.prior = math.log(prior / (1 - prior))

    def vocabulary(self) -> list[str]:
        return sorted(self.words.logp)

    def learned(self, odds: Mapping[str, float]) -> UrlModel:
        """This model with the log-odds of words that no list holds."""
        out = copy.copy(self)
        out.odds = {**odds, **self.odds}
        return out

    def tokens(self, host: str, path: str) -> list[str]:
        return [w for name in re.findall(r"[a-z]+", f"{host} {path.lower()}") for w in self.words.split(name)]

    def score(self, tokens: Sequence[str]) -> float:
        """Log-odds that the url is to be blocked; words of neither class say nothing."""
        return self.prior + sum(self.odds.get(w, 0.0) for w in tokens)


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, k), F.lit("")) for k in (1, 2))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def word_counts(pages: DataFrame, least: int = LEAST_HOSTS, most: int = VOCABULARY) -> DataFrame:
    """(word, hosts): the most frequent words of hosts and paths, by the number of different hosts. Counted over all urls; a hot host's rows are combined before the shuffle."""
    host, path = host_and_path(F.col("url"))
    words = F.regexp_extract_all(F.concat_ws(" ", "host", F.lower("path")), F.lit("[a-z]+"), 0)
    named = pages.select(host.alias("host"), path.alias("path")).where("host != ''").select("host", F.explode(words).alias("word")).distinct()
    return named.groupBy("word").agg(F.count(F.lit(1)).alias("hosts")).where(F.col("hosts") >= least).orderBy(F.desc("hosts"), "word").limit(most)


def host_words(pages: DataFrame, model: UrlModel) -> DataFrame:
    """(host, words): for each host the numbers of the vocabulary's words that its name or any of its paths holds, each once. A row holds VOCABULARY and listed words at most, however many urls the host has."""
    host, path = host_and_path(F.col("url"))
    sent = by_value(pages.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = received(sent)
        number = {w: i for i, w in enumerate(m.vocabulary())}
        for batch in batches:
            found = {(h, number[w]) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True) for w in m.tokens(h, p) if w in number}
            hosts, words = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(words, pa.int32())], names=["host", "word"])

    urls = pages.select(host.alias("host"), path.alias("path")).where("host != ''")
    pairs = urls.mapInArrow(run, "host string, word int").distinct()
    return pairs.groupBy("host").agg(F.collect_list("word").alias("words"))


def learn(pages: DataFrame, model: UrlModel, rounds: int = ROUNDS, shrink: float = SHRINK) -> UrlModel:
    """The model with what words outside the lists say, from all hosts of pages: each counts, once a word, for both classes by its probability under the model of the round before.

    The hosts' words are stored once; a round reads them and brings two counts for each word of the vocabulary to the driver. Urls without host take no part; no hosts leave the model as it is.
    """
    words = model.vocabulary()
    free = np.array([w not in model.odds for w in words], bool)
    hosts = stored(host_words(pages, model).select("words"), "host-words")
    odds = np.array([model.odds.get(w, 0.0) for w in words])
    for _ in range(rounds):
        sent = by_value(pages.sparkSession, (odds, model.prior))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            odds, prior = received(sent)
            total = np.zeros((2, len(odds)))
            for batch in batches:
                column = batch.column("words")
                at = np.array(column.flatten(), np.int64)
                row = np.repeat(np.arange(len(column)), np.diff(np.array(column.offsets)))
                score = prior + np.bincount(row, odds[at], len(column))
                block = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
                total += [np.bincount(at, p[row], len(odds)) for p in (block, 1 - block)]
            word = np.flatnonzero(total.sum(0))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(total[0, word]), pa.array(total[1, word])], names=["word", "block", "allow"])

        summed = hosts.mapInArrow(run, "word int, block double, allow double").groupBy("word").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")).collect()
        n = np.zeros((2, len(words)))
        for r in summed:
            n[:, r.word] = r.block, r.allow
        n[:, ~free] = 0
        seen = n.sum(0) > 0
        if not seen.any():
            break
        share = (n + shrink * n.sum(0) / n.sum()) / (n.sum(1, keepdims=True) + shrink)
        odds[seen] = np.log(share[0, seen]) - np.log(share[1, seen])
    released(hosts)
    return model.learned({words[i]: float(odds[i]) for i in np.flatnonzero(free & (odds != 0))})


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, model: UrlModel | None = None) -> DataFrame:
    """pages (with url) plus host, path, rule, url_words (array), url_score (log-odds of block) and verdict.

    model: by default one with the words of these pages, and with what learn() finds in them. A null url or one without :// has empty host and path; no rule fits it, and the prior allows it. Columns with the new
    names are replaced. Repeated rows stay and are judged alike.
    """
    new = ["host", "path", "rule", "url_words", "url_score", "verdict"]
    named, own = by_position(pages, new)
    url = F.col(named.columns[own.index("url")])
    urls = named.select(url.alias("url"))
    host, path = host_and_path(url)
    frame = named.select("*", host.alias("host"), path.alias("path"))
    fits = [F.when(((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p), F.struct(F.lit(len(h) + len(p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("says"))) for h, p, v in rules]
    best = F.array_max(F.filter(F.array(*fits), lambda x: x.isNotNull())) if fits else F.lit(None).cast("struct<n:int,rule:string,says:string>")
    frame = frame.withColumn("fit", best).select(*named.columns, "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.says").alias("says"))
    m = model or learn(urls, UrlModel({r.word: r.hosts for r in word_counts(urls).collect()}))  # VOCABULARY words at most
    sent = by_value(pages.sparkSession, m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = received(sent)
        known: dict[str, list[str]] = {}
        for batch in batches:
            words = []
            for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                if host not in known:
                    if len(known) > 100_000:
                        known.clear()
                    known[host] = m.tokens(host, "")
                words.append(known[host] + m.tokens("", path))
            scores = pa.array([m.score(w) for w in words], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words, pa.list_(pa.string())), scores], names=[*batch.schema.names, "url_words", "url_score"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema.fields)
    scored = frame.mapInArrow(run, f"{kept}, url_words array<string>, url_score double")
    verdict = F.coalesce("says", F.when(F.col("url_score") > 0, "block").otherwise("allow"))
    return scored.withColumn("verdict", verdict).select(*named.columns, *new).toDF(*own, *new)
