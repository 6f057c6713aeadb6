"""Languages of documents and of their segments by prediction with partial matching over bytes.

For each language a tree of byte contexts up to ``ORDER`` bytes with escape probabilities (method C) is frozen after
training. Each text has an exact code length under each tree; words carry the sum over their bytes, and the cheapest
way to assign languages to words, where a change costs extra bits, gives the segments.

The trees are laid out as sorted arrays: of every (context, byte) seen in any language the code length in all
languages with all escapes resolved, and of every context the cost of escaping from it. So most bytes take one lookup.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGES = ["ru", "en", "uk", "de", "kk", "fr"]
ORDER = 6
#: Bits that a change of language costs at the end of a sentence, and inside one.
SWITCH_END, SWITCH_INSIDE = 16.0, 40.0

_DIGIT = re.compile(r"\d")
_TAG = re.compile(r"</?\w+/?>")
_CLOSED = re.compile(r"(</\w+>|<br/?>)$")
_ITEM = re.compile(r"\d+[.)]")
_STOP = re.compile(r"[.!?…][\"'»”)\]]*$")
#: Bits by which one word can speak against a language, so that a name is no stretch of its own.
WORD_LIMIT = 16.0
#: Languages in which a capital letter starts no sentence.
CAPITAL_NOUNS = {"de"}
#: Words of a stretch without end marks that count as a sentence, where capitals tell and where they don't.
LONG_SENTENCE, LONG_WITHOUT_CAPITALS = 16, 10


def prepared(text: str) -> bytes:
    """The bytes that are modelled: the words in lower case with one space between, tags as | and words with digits as 0."""
    low = text.lower()
    if "<" in low:
        low = _TAG.sub("|", low)
    return " ".join([w if w.isalpha() or not _DIGIT.search(w) else "0" for w in low.split()]).encode("utf-8", "replace")


def _keys(data: np.ndarray, order: int) -> np.ndarray:
    """Of every byte the last order + 1 bytes as one integer; data starts with ORDER bytes of padding."""
    out = np.zeros(len(data) - ORDER, np.uint64)
    for j in range(order + 1):
        out |= data[ORDER - j : len(data) - j].astype(np.uint64) << np.uint64(8 * j)
    return out


def _at(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pos = np.searchsorted(table, keys)
    pos[pos == len(table)] = 0
    return pos, table[pos] == keys


class ContextTrees:
    """Frozen statistics of all languages."""

    def __init__(self, samples: list[list[bytes]]):
        """``samples``: for each language its training texts."""
        self.tables: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        n = len(samples)
        data = [np.frombuffer(b" " * ORDER + b"  ".join(s) + b" ", np.uint8) for s in samples]
        for k in range(ORDER + 1):
            grams, counts = zip(*(np.unique(_keys(d, k), return_counts=True) for d in data), strict=True)
            known = np.unique(np.concatenate(grams))
            seen = np.zeros((len(known), n))
            for i in range(n):
                seen[np.searchsorted(known, grams[i]), i] = counts[i]
            contexts, inverse = np.unique(known >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(contexts), n)), np.zeros((len(contexts), n))
            np.add.at(total, inverse, seen)
            np.add.at(kinds, inverse, seen > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, np.log2((total + kinds) / kinds), 0.0)
                direct = np.log2((total + kinds)[inverse] / seen)
            if k:
                pos, hit = _at(self.tables[-1][0], known & np.uint64((1 << 8 * k) - 1))
                lower = self.tables[-1][1][pos]
                if not hit.all():
                    raise ValueError("a context without its shorter one")
            else:
                lower = np.full((len(known), n), 8.0)
            cost = np.where(seen > 0, direct, escape[inverse] + lower)
            self.tables.append((known, cost.astype(np.float32), contexts, escape.astype(np.float32)))
        self.n = n

    def code_lengths(self, data: np.ndarray) -> np.ndarray:
        """Bits of every byte under every language; ``data`` starts with ORDER bytes of padding."""
        # equal contexts are looked up once, and in order, which the tables' cache lines reward
        codes, full = pd.factorize(_keys(data, ORDER))
        order = np.argsort(full)
        bits = np.empty((len(full), self.n), np.float32)
        bits[order] = self._resolved(full[order])
        return bits[codes]

    def _resolved(self, full: np.ndarray) -> np.ndarray:
        out = np.zeros((len(full), self.n), np.float32)
        todo = np.arange(len(out))
        for k in range(ORDER, -1, -1):
            known, cost, contexts, escape = self.tables[k]
            keys = full[todo] & np.uint64((1 << 8 * (k + 1)) - 1)
            pos, hit = _at(known, keys)
            out[todo[hit]] += cost[pos[hit]]
            todo, keys = todo[~hit], keys[~hit]
            if not len(todo):
                return out
            pos, hit = _at(contexts, keys >> np.uint64(8))
            out[todo[hit]] += escape[pos[hit]]
        out[todo] += 8.0
        return out


def word_costs(trees: ContextTrees, texts: list[str], chunk: int = 1_000_000) -> Iterator[tuple[int, np.ndarray]]:
    """(index of the text, bits of each of its words under each language), whole texts in chunks of about ``chunk`` bytes."""
    group: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> Iterator[tuple[int, np.ndarray]]:
        gap = b" " * (ORDER + 1)
        data = np.frombuffer(b" " * ORDER + gap.join(e for _, e in group) + gap, np.uint8)
        bits = trees.code_lengths(data)
        at = 0
        for i, encoded in group:
            own = bits[at : at + len(encoded) + 1]  # with the space behind the last word
            if not encoded:
                yield i, np.zeros((0, trees.n), np.float32)
            else:
                spaces = np.flatnonzero(data[ORDER + at : ORDER + at + len(encoded)] == 32) + 1
                sums = np.add.reduceat(own, np.concatenate(([0], spaces)), axis=0)
                yield i, np.minimum(sums, sums.min(axis=1, keepdims=True) + WORD_LIMIT)
            at += len(encoded) + len(gap)

    for i, text in enumerate(texts):
        encoded = prepared(text)
        group.append((i, encoded))
        size += len(encoded) + ORDER + 1
        if size >= chunk:
            yield from flush()
            group, size = [], 0
    if group:
        yield from flush()


_MAY_END = set(".!?…\"'»”)]>")


def _ends(word: str) -> bool:
    """Whether a sentence ends with the word."""
    if word[-1] not in _MAY_END:
        return False
    bare = _TAG.sub("", word) if word[-1] == ">" else word
    return (_STOP.search(bare) is not None and not _ITEM.fullmatch(bare)) or _CLOSED.search(word) is not None


def sentence_ends(text: str, words: list[str]) -> np.ndarray:
    """Of each word whether a sentence ends with it, by its marks or a line end behind it."""
    ends = np.fromiter(map(_ends, words), bool, len(words))
    if "\n" in text:
        n = 0
        for line in text.split("\n")[:-1]:
            n += len(line.split())
            if n:
                ends[n - 1] = True
    return ends


#: Words times documents of a group whose languages are assigned together.
CELLS = 2_000_000


def assign(costs: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The language of each word: cheapest total code length with costs for changes."""
    return assign_all([(costs, ends)])[0]


def assign_all(texts: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The languages of the words of many texts (costs, ends), none of them empty; each is as if alone.

    Texts in which no stretch is worth even one change take one pass. The rest go through the dynamic programme together,
    one step for the same word of all texts of a group, the longest first.
    """
    out: list[np.ndarray] = []
    todo = []
    for i, (costs, _) in enumerate(texts):
        n, m = costs.shape
        main = int(costs.sum(0).argmin())
        gain = np.cumsum(np.vstack([np.zeros((1, m)), costs[:, [main]] - costs]), axis=0)
        out.append(np.full(n, main))
        if (gain - np.minimum.accumulate(gain, axis=0)).max() > SWITCH_END:
            todo.append(i)
    todo.sort(key=lambda i: -len(texts[i][0]))
    while todo:
        longest = len(texts[todo[0]][0])
        group, todo = todo[: max(1, CELLS // longest)], todo[max(1, CELLS // longest) :]
        for i, path in zip(group, _cheapest([texts[i] for i in group]), strict=True):
            out[i] = path
    return out


def _cheapest(texts: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The cheapest paths of texts in falling order of length."""
    sizes = np.array([len(c) for c, _ in texts])
    length, b, m = int(sizes[0]), len(texts), texts[0][0].shape[1]
    costs, change = np.zeros((length, b, m), np.float32), np.zeros((length, b))
    for i, (c, e) in enumerate(texts):
        costs[: len(c), i] = c
        change[: len(c), i] = np.where(e, SWITCH_END, SWITCH_INSIDE)
    back = np.zeros((length, b, m), np.int8)
    going = np.searchsorted(-sizes, -np.arange(length), "left")  # texts of more than t words
    score, own, row = costs[0].astype(np.float64), np.arange(m, dtype=np.int8), np.arange(b)
    for t in range(1, length):
        g = going[t]
        s = score[:g]
        k = s.argmin(1)
        other = (s[row[:g], k] + change[t - 1, :g])[:, None]
        stay = s <= other
        back[t, :g] = np.where(stay, own, k[:, None])
        score[:g] = np.where(stay, s, other) + costs[t, :g]
    path = np.empty((length, b), np.int8)
    now = score.argmin(1)
    path[sizes - 1, row] = now
    for t in range(length - 1, 0, -1):
        g = going[t]
        now[:g] = back[t, row[:g], now[:g]]
        path[t - 1, :g] = now[:g]
    return [path[:n, i].astype(np.int64) for i, n in enumerate(sizes.tolist())]


def training_sample(docs: DataFrame, languages: list[str], per_language: int, max_chars: int) -> list[list[str]]:
    """At most ``per_language`` texts of at most ``max_chars`` characters of each label, chosen by a hash of the id."""
    label = F.lower(F.substring("lang", 1, 2))
    usable = docs.where(label.isin(languages) & F.length("text").between(40, max_chars)).select(label.alias("label"), "doc_id", "text")
    counts = usable.groupBy("label").count()
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    # a little more than wanted of each label by the hash, so that the exact cut sorts a bounded number of rows
    some = usable.join(F.broadcast(counts), "label").where(share * F.col("count") < per_language * 1.5 + 30).withColumn("share", share)
    rows = sorted(some.collect(), key=lambda r: (r["share"], r["doc_id"]))
    return [[r["text"] for r in rows if r["label"] == x][:per_language] for x in languages]


def train(docs: DataFrame, languages: list[str] | None = None, per_language: int = 400, max_chars: int = 4000, rounds: int = 2) -> ContextTrees:
    """Trees from labelled documents (doc_id, text, lang): a bounded sample whose wrong labels are sorted out by retraining.

    After each round only the words that the trees assign to the label's language stay in the training texts.
    """
    languages = languages or LANGUAGES
    sample = training_sample(docs, languages, per_language, max_chars)
    missing = [x for x, s in zip(languages, sample, strict=True) if not s]
    if missing:
        raise ValueError(f"no labelled text of {missing}")
    trees = ContextTrees([[prepared(t) for t in s] for s in sample])
    for _ in range(rounds):
        kept = []
        for i, texts in enumerate(sample):
            own = []
            told = [(k, costs) for k, costs in word_costs(trees, texts) if len(costs)]
            for (k, _), path in zip(told, assign_all([(costs, np.ones(len(costs), bool)) for _, costs in told]), strict=True):
                if (mine := path == i).mean() > 0.5:
                    own.append(b" ".join(w for w, m in zip(prepared(texts[k]).split(b" "), mine, strict=True) if m))
            kept.append(own or [prepared(t) for t in texts])
        trees = ContextTrees(kept)
    return trees


def segments(docs: DataFrame, trees: ContextTrees, languages: list[str] | None = None) -> DataFrame:
    """``doc_id, start_word, n_words, n_chars, n_sentences, lang, confidence`` of each stretch of one language, in order.

    confidence is the posterior of the language against the others for the stretch's bytes, for code lengths per
    byte scaled to 20 bytes, so it doesn't saturate with length. Defined cases: null, empty and blank texts have no
    segment; a text of codes and digits only has one, of low confidence; repeated rows give repeated segments.
    """
    languages = languages or LANGUAGES
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches:
            texts, ids = pdf["text"].tolist(), pdf["doc_id"].tolist()
            held: list[tuple[int, list[str], np.ndarray, np.ndarray]] = []
            size = 0
            for i, costs in word_costs(model, texts):
                words = texts[i].split()
                if words:
                    held.append((ids[i], words, costs, sentence_ends(texts[i], words)))
                    size += len(words)
                if size >= CELLS // 4:
                    yield stretches(held, languages)
                    held, size = [], 0
            yield stretches(held, languages)

    return docs.select("doc_id", "text").where("text <> ''").mapInPandas(cut, "doc_id long, start_word int, n_words int, n_chars int, n_sentences int, lang string, confidence double")


def stretches(texts: list[tuple[int, list[str], np.ndarray, np.ndarray]], languages: list[str]) -> pd.DataFrame:
    """The segments of texts (id, words, costs, sentence ends)."""
    rows = []
    paths = assign_all([(costs, ends) for _, _, costs, ends in texts])
    for (doc, words, costs, ends), langs in zip(texts, paths, strict=True):
        edges = [0, *(np.flatnonzero(np.diff(langs)) + 1).tolist(), len(words)]
        for a, b in zip(edges, edges[1:], strict=False):
            sums = costs[a:b].sum(0)
            size = len(" ".join(words[a:b]).encode()) + 1
            rel = 2.0 ** (-(sums - sums.min()) * min(1.0, 20.0 / size))
            rows.append((doc, a, b - a, sum(map(len, words[a:b])) + b - a - 1, count_sentences(words[a:b], ends[a:b], languages[langs[a]]), languages[langs[a]], float(rel[langs[a]] / rel.sum())))
    return pd.DataFrame(rows, columns=["doc_id", "start_word", "n_words", "n_chars", "n_sentences", "lang", "confidence"])


def count_sentences(words: list[str], ends: np.ndarray, lang: str) -> int:
    """Sentences of a stretch: by end marks, by capitals where those are missing, and by length where both are."""
    n, since = 0, 0
    capitals = lang not in CAPITAL_NOUNS and any(w[0].isupper() and w[1:].islower() for w in words)
    for k, w in enumerate(words):
        since += 1
        nxt = words[k + 1] if k + 1 < len(words) else ""
        if ends[k] or not nxt or (capitals and since >= 4 and nxt[0].isupper() and nxt[1:].islower() and w.islower()):
            if since >= 3:
                n += max(1, since // (LONG_SENTENCE if capitals else LONG_WITHOUT_CAPITALS))
            since = 0
    return max(n, 1)


def document_languages(parts: DataFrame, sentences: int = 2) -> DataFrame:
    """``doc_id, lang, n_sentences, n_chars, share, confidence, main``: the languages of which a document holds at least ``sentences`` sentences, else the one with most characters."""
    per = parts.groupBy("doc_id", "lang").agg(
        F.sum("n_sentences").alias("n_sentences"), F.sum("n_chars").alias("n_chars"), (F.sum(F.col("confidence") * F.col("n_chars")) / F.sum("n_chars")).alias("confidence")
    )
    # one row a language, so a handful a document
    all_ = per.groupBy("doc_id").agg(F.collect_list(F.struct("n_chars", "lang", "n_sentences", "confidence")).alias("l"), F.sum("n_chars").alias("total"))
    ranked = all_.withColumn("l", F.sort_array("l", asc=False)).withColumn("several", F.filter("l", lambda x: x["n_sentences"] >= sentences))
    held = F.when(F.size("several") >= 1, F.col("several")).otherwise(F.slice("l", 1, 1))
    return ranked.select("doc_id", "total", F.posexplode(held).alias("rank", "x")).select(
        "doc_id", F.col("x.lang").alias("lang"), F.col("x.n_sentences").alias("n_sentences"), F.col("x.n_chars").alias("n_chars"), (F.col("x.n_chars") / F.col("total")).alias("share"), F.col("x.confidence").alias("confidence"), (F.col("rank") == 0).alias("main")
    )


def mislabelled(languages: DataFrame, label: Column) -> DataFrame:
    """Adds ``case``: no label, one that isn't the document's language, or more than one language. ``languages`` holds all languages of a document, and its label."""
    per = languages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("main"), F.col("lang"))).alias("first"), F.first(label).alias("label"))
    missing = F.col("label").isNull() | F.lower("label").isin("", "und")
    wrong = F.lower(F.substring("label", 1, 2)) != F.col("first")
    return per.select("doc_id", (missing | wrong | (F.col("n") > 1)).alias("case"))
