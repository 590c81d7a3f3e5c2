"""Subject areas of documents: labelling functions weighed by a latent model that learns their accuracy."""

from __future__ import annotations

import re
import unicodedata
import warnings
from collections import Counter
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Labelled documents, and documents whose section names a subject, from which the lexicon is fitted at most.
FIT_DOCS = 20_000
#: A term is a run of up to so many words, none of its ends in more than this share of the documents of most subjects.
TERM_WORDS, STOP_SHARE = 3, 0.12
#: A term names a subject if this share of its documents has it and that is no chance (nats over the prior);
#: it is ambiguous between two or three subjects if they share it out among themselves.
TERM_PURITY, TERM_EVIDENCE, SPLIT_PURITY, SPLIT_EVIDENCE = 0.6, 9.0, 0.65, 25.0
#: Documents that a term needs.
LEAST_DOCS = 5
#: The lexicon's answers: no sentence, one, and from two on the share of the sentences that are neither formula nor remark, by these edges.
SHARES = (1 / 16, 1 / 10, 1 / 8, 1 / 6, 1 / 4)
#: The answer from which on a pair is taken for true at first ("about a sixth").
LIKELY = 3 + SHARES.index(1 / 8)
#: Sentence that stands in more than this share of the distinct texts, and in more than so many: formula.
FORMULA_SHARE, FORMULA_DOCS = 0.002, 5
#: How the lexicon answers to false and to true pairs as far as the statement tells: one sentence is none, a sixth of the speech is enough.
#: Counts as much as OPINION times all pairs of the corpus, so that the classes keep their meaning at every size;
#: EVEN votes for each answer of the other functions stand in for what a small corpus can't tell.
OPINION, EVEN = 3.0, 2.0
PRIOR = (np.array([0.25, 0.55, 0.08, 0.08, 0.03, 0.006, 0.002, 0.002]), np.array([0.001, 0.003, 0.001, 0.003, 0.02, 0.05, 0.1, 0.822]))
#: Posterior from which a subject is assigned, and rounds of the latent model.
LEAST_POSTERIOR, ROUNDS = 0.5, 500

_REMARK = re.compile(r"\([^()]{0,300}\)|\[[^\[\]]{0,300}\]")
_ASIDE = re.compile(r"(?:(?<=\s)|^)(--|–|—|-)\s[^–—]{1,100}?\s\1(?=\s|$)")
_BREAK = re.compile(r"-[ \t]*\n\s*")
_QUOTE = re.compile(r"[“„\"«]([^“”„\"«»]{0,1500})[”“\"»]")
#: Letters from which a quotation is long; shorter ones are the speaker's own words.
LONG_QUOTE = 60
#: A sentence ends at these marks, but not after a title or an initial.
_END = re.compile(r"[.!?](?<!\bDr\.)(?<!\bMr\.)(?<!\bMs\.)(?<!\bSt\.)(?<!\bNr\.)(?<!\W[A-ZÄÖÜ]\.)(?=\s|$)")
_OTHER = re.compile(r"(?:[^\w\n]|[\d_])+")
_LATIN = bytes(
    ord("\n") if i == 10 else ord(chr(i).lower()) if chr(i).isalpha() and len(chr(i).lower()) == 1 and ord(chr(i).lower()) < 256 else 32 for i in range(256)
)


def sentences(text: str | None) -> list[list[str]]:
    """The sentences of a text as lower-case words without numbers and final s; remarks and long quotations are taken out."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.replace("\xad", ""))
    if "(" in text or "[" in text:
        text = _REMARK.sub(" ", text)
    if "-" in text or "–" in text or "—" in text:
        text = _BREAK.sub("", _ASIDE.sub(" ", text))
    if '"' in text or "“" in text or "„" in text or "«" in text:
        text = _QUOTE.sub(lambda m: " " if len(m[1]) >= LONG_QUOTE else m[0], text)
    text = _END.sub("\n", text.replace("\n", " "))
    try:
        text = text.replace("–", " ").replace("’", " ").replace("“", " ").replace("”", " ").replace("„", " ").encode("latin-1").translate(_LATIN).decode("latin-1")
    except UnicodeEncodeError:
        text = _OTHER.sub(" ", text.lower())
    # a final s is taken off every word, here and in the terms alike, so that plurals meet their singulars
    return [w for w in (s.split() for s in f"{text}\n".replace("s ", " ").replace("s\n", "\n").split("\n")) if w]


def _terms(words: list[str], stop: set[str]) -> Iterator[str]:
    """Runs of words that can be terms."""
    n = len(words)
    for a in range(n):
        if words[a] in stop or len(words[a]) < 2:
            continue
        for b in range(a + 1, min(a + TERM_WORDS, n) + 1):
            if words[b - 1] not in stop:
                yield " ".join(words[a:b])


def description_terms(title: str | None, description: str | None) -> list[str]:
    """The terms that a description of the form 'title: matters such as a, b, c.' lists."""
    listed = re.sub(r"^.*?\bsuch as\b", "", description or "", flags=re.S)
    return [t for t in (" ".join(w for s in sentences(x) for w in s) for x in re.split(r"[,;]", listed)) if t]


def fit_lexicon(training: DataFrame, subjects: list[str], seeds: dict[str, int]) -> dict[str, list[int]]:
    """Terms and the numbers of the subjects they name, from (text, subject number or null) rows.

    The rows are a bounded sample of labelled documents; their counts are added up
    per partition, and only terms that pass the tests come to the driver.
    """
    k, spark = len(subjects), training.sparkSession

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, int]] = Counter()
        for batch in batches:
            for text, subject in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.update((w, k if subject is None else subject) for w in {w for s in sentences(text) for w in s} | {""})
        yield pa.record_batch([pa.array([w for w, _ in seen], pa.string()), pa.array([s for _, s in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["word", "subject", "n"])

    held = cut(training)
    tally = cut(held.select("text", "subject").mapInArrow(words, "word STRING, subject INT, n BIGINT").groupBy("word", "subject").agg(F.sum("n").alias("n")))
    docs = {r["subject"]: r["n"] for r in tally.where("word = ''").collect()}  # one per subject
    # function words: frequent under more than half of the subjects, so at most a few times (words of a document / STOP_SHARE)
    sized = spark.createDataFrame(list(docs.items()) or [(0, 0)], "subject INT, docs BIGINT")
    common = tally.join(F.broadcast(sized), "subject").where((F.col("n") > STOP_SHARE * F.col("docs")) & (F.col("n") > 3)).groupBy("word").agg(F.count("*").alias("c"))
    stop = {r["word"] for r in common.where(F.col("c") * 2 > len(docs)).collect()}

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, subject in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = k if subject is None else subject
                for term in {t for s in sentences(text) for t in _terms(s, stop)} | {""}:
                    if (c := seen.get(term)) is None:
                        c = seen[term] = np.zeros(k + 1, np.int64)
                    c[at] += 1
        yield pa.record_batch([pa.array(list(seen), pa.string()), *[pa.array(x) for x in (np.array(list(seen.values())).T if seen else np.empty((k + 1, 0), np.int64))]], names=["term", *[f"s{i}" for i in range(k + 1)]])

    fields = [f"s{i}" for i in range(k + 1)]
    added = held.select("text", "subject").mapInArrow(counts, "term STRING, " + ", ".join(f"{f} BIGINT" for f in fields)).groupBy("term").agg(*[F.sum(f).alias(f) for f in fields])
    # a term of too few documents passes no test
    added = cut(added.where((sum((F.col(f) for f in fields[1:]), F.col(fields[0])) >= LEAST_DOCS) | (F.col("term") == "")))
    total = np.array(added.where("term = ''").select(*fields).first() or [0] * (k + 1), float)
    prior = (total + 1) / (total.sum() + k + 1)
    test = _namer(prior, seeds)
    named = added.where("term <> ''").mapInArrow(test, "term STRING, names ARRAY<INT>")
    # terms of at most twice fit_docs documents that pass a test
    return {t: [s] for t, s in seeds.items()} | {r["term"]: list(r["names"]) for r in named.collect()}


def _namer(prior: np.ndarray, seeds: dict[str, int]):
    """The tests of the terms' counts: a term names a subject, or two or three that share it out; others are left out."""
    k = len(prior) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = np.array([x.to_numpy(zero_copy_only=False) for x in batch.columns[1:]], float).T.reshape(-1, k + 1)
            p = c[:, :k] / c.sum(axis=1, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                evidence = np.where(c[:, :k] > 0, c[:, :k] * np.log(p / prior[:k]), 0.0)
            best = p.argmax(axis=1) if len(p) else np.empty(0, int)
            at = np.arange(len(p))
            pure = p[at, best] >= TERM_PURITY
            split = (p >= 0.2) & (p >= 2.5 * prior[:k])
            shared = np.isin(split.sum(axis=1), (2, 3)) & ((p * split).sum(axis=1) >= SPLIT_PURITY) & ((evidence * split).sum(axis=1) >= SPLIT_EVIDENCE)
            terms, names = [], []
            for i, term in enumerate(batch.column(0).to_pylist()):
                if pure[i]:
                    if evidence[i, best[i]] < TERM_EVIDENCE:
                        continue
                    found = [int(best[i])]
                elif shared[i]:
                    found = np.flatnonzero(split[i]).tolist()
                elif term in seeds and c[i].sum() >= 20 and p[i, seeds[term]] < 0.5:
                    # a listed word that is used mostly otherwise counts only beside clear ones
                    found = sorted({seeds[term], *np.flatnonzero(split[i]).tolist()})
                else:
                    continue
                terms.append(term)
                names.append(found)
            yield pa.record_batch([pa.array(terms, pa.string()), pa.array(names, pa.list_(pa.int32()))], names=["term", "names"])

    return run


def automaton(lexicon: dict[str, list[int]]) -> ahocorasick.Automaton:
    """Finds the terms between doubled spaces."""
    a = ahocorasick.Automaton()
    for term, names in lexicon.items():
        a.add_word(" " + term.replace(" ", "  ") + " ", tuple(names))
    a.make_automaton()
    return a


COUNTS = "doc BIGINT, subject INT, n INT, first BOOLEAN, section INT, `from` STRING, plain ARRAY<BIGINT>, total INT, said BIGINT"


def _counter(lexicon: dict[str, list[int]], titles: dict[str, int]):
    schema = pa.schema([
        ("doc", pa.int64()), ("subject", pa.int32()), ("n", pa.int32()), ("first", pa.bool_()),
        ("section", pa.int32()), ("from", pa.string()), ("plain", pa.list_(pa.int64())), ("total", pa.int32()), ("said", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = automaton(lexicon)
        for batch in batches:
            rows = []
            for doc, text, agenda, source in zip(*(c.to_pylist() for c in batch.columns)):
                clear: Counter[int] = Counter()
                unclear, plain, first, total, said = [], [], None, 0, xxhash.xxh64()
                for words in sentences(text):
                    total += 1
                    said.update(" ".join(words) + "\n")
                    found = {n for _, n in finder.iter_long(" " + "  ".join(words) + " ")} if lexicon else set()
                    sure = {n[0] for n in found if len(n) == 1}
                    if sure:
                        clear.update(sure)
                        first = sure if first is None else first
                    elif found:
                        unclear.append(found)
                    else:
                        plain.append(xxhash.xxh64_intdigest(" ".join(words)) - (1 << 63))
                both = Counter(clear)
                for found in unclear:  # an ambiguous term goes to the subject that the speech has otherwise
                    for s in {max(n, key=lambda j: clear[j]) for n in found}:
                        if clear[s]:
                            both[s] += 1
                section = section_subject(agenda, titles)
                rows.append((doc, None, 0, False, section, source, plain, total, said.intdigest() - (1 << 63)))
                for s in both.keys() | ({section} - {None}):
                    rows.append((doc, s, both[s], bool(first and s in first), section, source, None, total, None))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema)

    return run


def section_subject(agenda: str | None, titles: dict[str, int]) -> int | None:
    """The subject whose title an agenda item is, apart from its number and a note in brackets."""
    plain = " ".join(re.sub(r"\(.*?\)|\d+\.?", " ", agenda or "").lower().split())
    return titles.get(plain)


#: The labelling functions and the number of their answers: lexicon (by SHARES), address (another subject, this), section (none, this, another), source (untypical, typical).
FUNCTIONS = ("lexicon", "address", "section", "source")
LEVELS = (3 + len(SHARES), 2, 3, 2)
#: The answer by which a function abstains: it then says nothing for or against.
ABSTAINS = (None, None, 0, None)


def fit_accuracies(patterns: dict[tuple[int, ...], int], functions: Sequence[str] = FUNCTIONS, rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Posterior of each pattern of votes, by expectation maximisation over all (document, subject) pairs.

    A pair's truth is latent; given it, each labelling function answers by its
    own distribution, which is learned without labels from how the functions
    agree. Only the lexicon's starts from an opinion, PRIOR. Functions that are
    left out abstain.
    """
    keys = list(patterns)
    weight = np.array([patterns[x] for x in keys], float)
    votes = np.array(keys, int).reshape(len(keys), len(LEVELS))
    post = np.where(votes[:, 0] >= LIKELY, 0.9, np.where(votes[:, 0] > 0, 0.1, 0.005))
    whole = weight.sum()
    for _ in range(rounds):
        share = ((weight * post).sum() + 1) / (whole + 2)
        score = np.tile(np.log([[1 - share, share]]), (len(keys), 1))
        for f, n in enumerate(LEVELS):
            says = (votes[:, f] != ABSTAINS[f]) if ABSTAINS[f] is not None else np.ones(len(keys), bool)
            if FUNCTIONS[f] not in functions or not says.any():
                continue
            for y, p in enumerate((1 - post, post)):
                chance = np.bincount(votes[says, f], weights=(weight * p)[says], minlength=n) + (PRIOR[y] * OPINION * max(whole, 1.0) if f == 0 else EVEN)
                score[says, y] += np.log(chance / chance.sum())[votes[says, f]]
        new = 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -50, 50)))
        settled = np.abs(new - post).max(initial=0) < 1e-6
        post = new
        if settled:
            break
    else:
        warnings.warn("accuracies of the labelling functions did not settle", stacklevel=2)
    return dict(zip(keys, post.tolist()))


def subject_votes(documents: DataFrame, subjects: DataFrame, labels: DataFrame, *, fit_docs: int = FIT_DOCS) -> tuple[DataFrame, list[str]]:
    """What each labelling function says of each (document, subject): (doc, subject number, n, share and FUNCTIONS), and the names.

    Pairs without a sentence that are not of the section either are left out: no function speaks for them.
    """
    spark = documents.sparkSession
    areas = subjects.where("subject IS NOT NULL").select("subject", "title", "description").collect()  # a handful
    names = sorted({r["subject"] for r in areas})
    number = {s: i for i, s in enumerate(names)}
    titles = {" ".join((r["title"] or "").lower().split()): number[r["subject"]] for r in areas if r["title"]}
    seeds = {t: number[r["subject"]] for r in areas for t in description_terms(r["title"], r["description"])}
    docs = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc"), "text", F.col("agenda_item").alias("agenda"), F.lower(F.trim("source")).alias("from"))

    once = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc")).agg(F.collect_set("subject").alias("s"))
    known = spark.createDataFrame([(s, i) for s, i in number.items()] or [("", 0)], "name STRING, subject INT")
    # one subject or none: what a document of several says of a term is unclear
    sure = once.where("size(s) <= 1").select("doc", F.try_element_at("s", F.lit(1)).alias("name")).join(F.broadcast(known), "name", "left").where("name IS NULL OR subject IS NOT NULL")
    sure = sure.orderBy(F.xxhash64("doc")).limit(fit_docs).select("doc", "subject")
    by_title = spark.createDataFrame([(t, i) for t, i in titles.items()] or [("", 0)], "plain STRING, subject INT")
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower("agenda"), r"\(.*?\)|\d+\.?", " "), r"\s+", " "))
    sections = docs.select("doc", plain.alias("plain")).join(F.broadcast(by_title), "plain").orderBy(F.xxhash64("doc")).limit(fit_docs).select("doc", "subject")
    both = cut(sure.unionByName(sections.join(once, "doc", "left_anti")))  # at most twice fit_docs rows
    lexicon = fit_lexicon(docs.join(F.broadcast(both), "doc").select("text", F.col("subject").cast("int").alias("subject")), names, seeds)

    counted = cut(docs.select("doc", "text", "agenda", "from").mapInArrow(_counter(lexicon, titles), COUNTS))
    heads = counted.where("subject IS NULL").select("doc", "from", "plain", "total", "said")
    n_docs = heads.count()
    # sentences without a term that recur all over the corpus: at most (sentences of a document / FORMULA_SHARE) of them; copies of a text count once
    texts = cut(heads.groupBy("said").agg(F.first("plain").alias("plain")).select(F.array_distinct("plain").alias("plain")))
    formulas = (
        texts.select(F.explode("plain").alias("h")).groupBy("h").agg(F.count("*").alias("c"))
        .where(F.col("c") > max(FORMULA_SHARE * texts.count(), FORMULA_DOCS)).select("h")
    )
    procedure = heads.select("doc", F.explode("plain").alias("h")).join(F.broadcast(formulas), "h").groupBy("doc").agg(F.count("*").alias("formulas"))
    pairs = counted.where("subject IS NOT NULL").select("doc", "subject", "n", "first", "section", "from", "total").join(procedure, "doc", "left")
    share = F.try_divide(F.col("n").cast("double"), F.greatest(F.lit(1), F.col("total") - F.coalesce("formulas", F.lit(0))))
    band = sum((F.when(F.col("share") >= e, 1).otherwise(0) for e in SHARES), F.lit(2))
    pairs = cut(pairs.withColumn("share", share).withColumn("lexicon", F.when(F.col("n") < 2, F.col("n")).otherwise(band)).drop("total", "formulas"))
    # a subject is typical of a source if it is half again as frequent there as overall
    of_source = heads.groupBy("from").agg(F.count("*").alias("docs"))
    strong = pairs.where(F.col("lexicon") >= LIKELY)
    overall = strong.groupBy("subject").agg((F.count("*") / F.lit(max(n_docs, 1))).alias("usual"))
    typical = strong.groupBy("from", "subject").agg(F.count("*").alias("c")).join(of_source, "from").join(overall, "subject").where("c >= 20 AND c / docs >= 1.5 * usual").select("from", "subject", F.lit(1).alias("source"))
    voted = pairs.join(typical, ["from", "subject"], "left").select(
        "doc", "subject", "n", "share", "lexicon", F.col("first").cast("int").alias("address"),
        F.when(F.col("section").isNull(), 0).when(F.col("section") == F.col("subject"), 1).otherwise(2).alias("section"), F.coalesce("source", F.lit(0)).alias("source"),
    )
    return voted, names


def subject_areas(documents: DataFrame, subjects: DataFrame, labels: DataFrame, *, fit_docs: int = FIT_DOCS, functions: Sequence[str] = FUNCTIONS) -> DataFrame:
    """The subjects of each document, with posterior probability, sentences and share.

    ``documents``: doc_id, text, agenda_item, source; ``subjects``: subject,
    title, description; ``labels``: doc_id, subject (null: none).

    A lexicon is fitted on at most ``fit_docs`` labelled documents and as many
    whose section names a subject, from the descriptions' terms on. Every
    document's sentences are then counted per subject over the whole text, and
    four labelling functions vote on each (document, subject): the lexicon (its
    sentences and their share of those that are neither formula, remark nor
    quotation); the address (the first sentence on any subject); the section
    (agenda item); the source (whether the subject is typical of it). Their
    accuracies come from a latent model over the votes of all documents. A subject
    is assigned when its posterior is at least LEAST_POSTERIOR. Functions not
    named in ``functions`` abstain.

    Rows with null document id are left out; of repeated ids each row is judged
    on its own and equal results come out once. Null and empty texts have no
    subject. Empty tables give none. Extra columns are ignored.

    Returns (doc_id, subject, sentences, share, posterior).
    """
    voted, names = subject_votes(documents, subjects, labels, fit_docs=fit_docs)
    patterns = {tuple(r[v] for v in FUNCTIONS): r["c"] for r in voted.groupBy(*FUNCTIONS).agg(F.count("*").alias("c")).collect()}  # at most the product of LEVELS
    posterior = fit_accuracies(patterns, functions)
    scored = documents.sparkSession.createDataFrame([(*k, p) for k, p in posterior.items()], ", ".join(f"{v} INT" for v in FUNCTIONS) + ", posterior DOUBLE")
    named = F.element_at(F.array(*[F.lit(s) for s in names or [""]]), F.col("subject") + 1)
    return (
        voted.join(F.broadcast(scored), list(FUNCTIONS)).where(F.col("posterior") >= LEAST_POSTERIOR)
        .select(F.col("doc").alias("doc_id"), named.alias("subject"), F.col("n").alias("sentences"), "share", "posterior")
        .distinct()
    )
