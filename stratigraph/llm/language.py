"""Languages of documents and of the segments of mixed ones, with confidence.

Texts are split into sentences; code, identifiers, markup and numbers are taken out, and what has too few words left is
no prose. A sentence's character n-grams, one to four characters long and hashed to a fixed number of buckets, weighted
by TF-IDF, go through a sparse multinomial logistic regression. It is trained by follow-the-regularised-leader with
an elastic-net penalty, on sentences of labelled documents; since labels may be wrong, a first model drops the
sentences it contradicts before the second is trained. A temperature, fitted on held-out sentences, calibrates the
confidence. Document frequencies come from all sentences of all documents; only the training sentences are a sample,
bounded by ``train_sentences``.

A language belongs to a document when at least ``min_sentences`` whole sentences are in it; where none has that many, the
document has the one language most probable over all its prose.

Cases: null, blank and code-only texts have no language and give no rows; labels are read as code, ISO 639-3 code or English
name with any case, region suffix or blanks; all else is no label; UTF-8 read as Latin-1 is repaired; texts are read
whole; documents with one id are separate rows; empty input gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratigraph.llm.bpe import spread

BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
SCALE = 12.0

_FENCE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`", re.S)
_MARKUP = re.compile(r"&[a-z#0-9]{1,8};|</?[a-zA-Z][^<>\n]{0,60}>|https?://\S+|\[\s*\d[^\]\n]*\]")
_NAME_PART = re.compile(r"[_/\\@#=\d]|(?<=[a-z])[A-Z]|::|--|(?<=\w)(?:\(|\.\w)")
_MAY_MARK = re.compile(r"[&<\[]|://")
_SENTENCE = re.compile(r"(?<=[.!?…])[)\"'»”’]*\s+|(?<=[。！？])|[\r\n]+")
_LEAD = re.compile(r"^[\s>*#\-+•·\d.()]*(?:\(?[A-Za-z]{2,16}\)?:\s+)?")
_MARKS = re.compile(r"[{};=|\\^~<>]|\w\((?!s\))")
_CODE = re.compile(r"^\s*(?:return|import|from|package|for|if|elif|while|else|try|except|with|switch|case|default|class|def|let|var|const|func|fn|use)\b[^.!?]*[:;{(]\s*$")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CJK = re.compile(r"[぀-ヿ㐀-䶿一-鿿가-힯]")
_MOJIBAKE = re.compile(r"(?:[Â-ß][\u0080-¿]|[à-ï][\u0080-¿]{2}|[ð-ô][\u0080-¿]{3})+")


def _repair(m: re.Match) -> str:
    try:
        return m[0].encode("latin-1").decode("utf-8")
    except UnicodeError:
        return m[0]


def sentences(text: str | None) -> list[tuple[int, int, str]]:
    """start, end and cleaned words of every prose sentence of a text."""
    if not text:
        return []
    blank = lambda m: " " * len(m[0])
    body = _FENCE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text) if "`" in text else text
    body = _MARKUP.sub(blank, body) if _MAY_MARK.search(body) else body
    out, pos = [], 0
    for cut in [*(m.span() for m in _SENTENCE.finditer(body)), (len(body), len(body))]:
        start, end = pos, cut[0]
        pos = cut[1]
        s = body[start:end]
        lead = _LEAD.match(s).end()
        s = s[lead:]
        last = s.rstrip()[-1:]
        if _MARKS.search(s) or (last and last in ":;{(" and _CODE.search(s.rstrip())):
            continue
        plain = s.isascii()
        clean = s if plain else _MOJIBAKE.sub(_repair, s)
        if _NAME_PART.search(clean):  # names, paths, calls and numbers are no words of a language
            clean = " ".join([w for w in clean.split() if not _NAME_PART.search(w)])
        clean = (clean if plain else unicodedata.normalize("NFKC", clean)).lower()
        words = _WORD.findall(clean)
        if any([len(w) > 30 for w in words]):
            words = [w for w in words if len(w) <= 30 or _CJK.search(w)]
        cjk = 0 if plain else sum(len(_CJK.findall(w)) for w in words)
        ended = s.rstrip(" )\"'»”’*_`")[-1:] in set(".!?…。！？")
        if cjk >= 4 or (len(words) >= (3 if ended else 4) and sum(map(len, words)) >= 9):
            out.append((start + lead, end, " ".join(words)))
    return out


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram buckets of all texts, in order of the texts, and how many each text has."""
    joined = "\0".join(f" {t} " for t in texts) + "\0"
    c = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    end = c == 0
    owner = np.cumsum(end) - end
    hs, os_ = [], []
    run, ok = np.zeros(len(c), np.uint64), np.ones(len(c), bool)
    for n in range(1, max(ORDERS) + 1):
        shifted = np.r_[c[n - 1 :], np.zeros(n - 1, np.uint64)]
        ok = ok & (shifted != 0)
        run = (run * np.uint64(0x9E3779B97F4A7C15) + shifted + np.uint64(n)) & np.uint64(0xFFFFFFFFFFFFFFFF)
        if n in ORDERS:
            h = run ^ (run >> np.uint64(29))
            h = (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - 16)
            hs.append(h[ok].astype(np.int32))
            os_.append(owner[ok])
    # the script of a character: a block of 256 code points
    letters = ok_letters = (c > 32)
    hs.append((((c[letters] >> np.uint64(8)) * np.uint64(0x94D049BB133111EB)) >> np.uint64(32)).astype(np.int64).astype(np.int32) & (BUCKETS - 1))
    os_.append(owner[ok_letters])
    o = np.concatenate(os_)
    order = np.argsort(o, kind="stable")
    return np.concatenate(hs)[order], np.bincount(o, minlength=len(texts))


def weights_of(idx: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF value of each occurrence, each text's summing to SCALE."""
    v = idf[idx]
    total = np.add.reduceat(np.r_[v, 0.0], np.r_[0, np.cumsum(counts)[:-1]]) if len(counts) else np.zeros(0)
    total = np.where(counts > 0, total, 1.0)
    return v * np.repeat(SCALE / np.maximum(total, 1e-9), counts)


def logits(idx: np.ndarray, val: np.ndarray, counts: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One row of class scores a text."""
    out = np.zeros((len(counts), w.shape[1]))
    some = np.flatnonzero(counts)
    if len(some):
        starts = (np.cumsum(counts) - counts)[some]
        for k in range(w.shape[1]):  # a column at a time stays in the cache
            out[some, k] = np.add.reduceat(w[:, k].copy()[idx] * val, starts)
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train_ftrl(texts: list[str], y: np.ndarray, idf: np.ndarray, classes: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 3, batch: int = 256, seed: int = 7) -> np.ndarray:
    """Weights (buckets x classes) of a multinomial logistic regression by FTRL-proximal with elastic net."""
    z = np.zeros((BUCKETS, classes))
    n = np.zeros((BUCKETS, classes))

    def current(u: np.ndarray) -> np.ndarray:
        zu = z[u]
        return np.where(np.abs(zu) <= l1, 0.0, -(zu - np.sign(zu) * l1) / ((beta + np.sqrt(n[u])) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for s in range(0, len(order), batch):
            pick = order[s : s + batch]
            idx, counts = features([texts[i] for i in pick])
            val = weights_of(idx, counts, idf)
            u, inv = np.unique(idx, return_inverse=True)
            w = current(u)
            p = softmax(logits(inv, val, counts, w))
            p[np.arange(len(pick)), y[pick]] -= 1
            per = np.repeat(np.arange(len(pick)), counts)
            g = np.empty_like(w)
            for k in range(classes):
                g[:, k] = np.bincount(inv, weights=val * p[per, k], minlength=len(u))
            g /= max(1, len(pick)) ** 0.5
            nu = n[u]
            z[u] += g - (np.sqrt(nu + g * g) - np.sqrt(nu)) / alpha * w
            n[u] = nu + g * g
    return current(np.arange(BUCKETS)).astype(np.float32)


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature, at least 0.2, with the least log loss on held-out texts (no error there says nothing of less)."""
    grid = np.geomspace(0.2, 10, 80)
    loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))]) if len(y) else 1.0


def _plain(t: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFD", t) if not unicodedata.combining(ch))


class Model:
    """Trained weights; ``predict`` gives calibrated probabilities of sentences."""

    def __init__(self, codes: list[str], idf: np.ndarray, w: np.ndarray, t: float, accuracy: float):
        self.codes, self.idf, self.w, self.t, self.accuracy = codes, idf, w, t, accuracy

    def scores(self, texts: list[str]) -> np.ndarray:
        out = []
        at: dict[str, int] = {}
        where = np.fromiter((at.setdefault(t, len(at)) for t in texts), np.int64, len(texts))
        once = list(at)  # a sentence that repeats is scored once
        for i in range(0, len(once), 2000):  # slices of bounded memory
            idx, counts = features(once[i : i + 2000])
            out.append(logits(idx, weights_of(idx, counts, self.idf).astype(np.float32), counts, self.w))
        return np.concatenate(out)[where]

    def predict(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros((0, len(self.codes)))
        return softmax(self.scores(texts) / self.t)


def fit(samples: list[tuple[str, str]], codes: list[str], idf: np.ndarray) -> Model:
    """A model from (language, sentence) pairs of which some labels are wrong; a tenth is held out."""
    texts = [t for _, t in samples]
    y = np.array([codes.index(c) for c, _ in samples], int)
    keep = np.arange(len(texts)) % 10 != 0

    def train(sel: np.ndarray) -> np.ndarray:
        i = np.flatnonzero(sel)
        both = [texts[k] for k in i] + [_plain(texts[k]) for k in i]  # also without accents
        return train_ftrl(both, np.r_[y[i], y[i]], idf, len(codes))

    if not len(texts):
        return Model(codes, idf, np.zeros((BUCKETS, len(codes)), np.float32), 1.0, 0.0)
    m = Model(codes, idf, train(keep), 1.0, 0.0)
    p = m.predict(texts)
    sound = p[np.arange(len(y)), y] >= 0.5 * p.max(axis=1)
    m = Model(codes, idf, train(keep & sound), 1.0, 0.0)
    held = np.flatnonzero(~keep & sound)
    if len(held):
        z = m.scores([texts[i] for i in held])
        m.t, m.accuracy = temperature(z, y[held]), float((z.argmax(axis=1) == y[held]).mean())
    return m


def label_code(lang: Column, languages: DataFrame) -> Column:
    """The language code a label names; null if it names none. ``languages`` is a small fixed table."""
    names = {}
    for r in languages.collect():
        for v in (r["code"], r["name"], r["iso3"]):
            if v:
                names[v.strip().lower()] = r["code"]
    key = F.lower(F.trim(lang))
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(m[key], m[F.regexp_extract(key, r"^([a-z]{2,3})[-_][a-z0-9_-]+$", 1)])


def corpus_idf(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Inverse document frequencies of all buckets over all sentences of all documents: a vector of fixed size."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            texts = Counter(s[2] for t in b[text_col] for s in sentences(t))
            once, often = list(texts), np.fromiter(texts.values(), np.float64, len(texts))
            n += int(often.sum())
            for i in range(0, len(once), 2000):
                part = once[i : i + 2000]
                idx, counts = features(part)
                own = np.repeat(np.arange(len(part), dtype=np.int32), counts)
                seen = np.unique(own << 16 | idx)
                df += np.bincount(seen & (BUCKETS - 1), weights=often[i : i + 2000][seen >> 16], minlength=BUCKETS).astype(np.int64)
        yield pd.DataFrame({"k": np.r_[-1, np.flatnonzero(df)], "v": np.r_[n, df[df > 0]]})

    got = spread(docs.select(text_col)).mapInPandas(count, "k int, v bigint").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    df = np.zeros(BUCKETS)
    real = got[got.k >= 0]
    df[real.k.to_numpy(int)] = real.v.to_numpy(float)
    n = float(got.v[got.k == -1].sum())
    return np.log((1 + n) / (1 + df)) + 0.1


def train_on(docs: DataFrame, languages: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", train_docs: int = 6000, per_doc: int = 8, train_sentences: int = 20_000) -> Model:
    """Fit on at most ``train_sentences`` sentences of ``train_docs`` labelled documents, both chosen by hash.

    A document gives at most ``per_doc`` sentences, spread over it, lest one long text with a wrong label teach it.
    """
    codes = sorted(r["code"] for r in languages.select("code").distinct().collect())
    lab = docs.select(F.col(id_col).cast("string").alias("_i"), F.col(text_col).alias("_t"), label_code(F.col(label_col), languages).alias("_l")).where("_l is not null and _t is not null and _i is not null")
    # at most train_docs ids: bounded by the parameter, safe to broadcast
    ids = lab.select("_i").orderBy(F.xxhash64("_i"), "_i").limit(train_docs)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, c, s[2]) for i, t, c in zip(b["_i"], b["_t"], b["_l"]) for k, s in some(sentences(t))]
            yield pd.DataFrame(rows, columns=["i", "k", "c", "s"])

    def some(ss: list) -> list[tuple[int, tuple]]:
        n = len(ss)
        return [(k, ss[k]) for k in sorted({j * n // per_doc for j in range(per_doc)} if n > per_doc else range(n))]

    rows = lab.join(F.broadcast(ids), "_i", "left_semi").mapInPandas(split, "i string, k int, c string, s string").withColumn("h", F.xxhash64("i", "k"))
    sample = [(r["c"], r["s"]) for r in rows.orderBy("h", "i", "k").limit(train_sentences).collect()]
    return fit(sample, codes, corpus_idf(docs, text_col))


def segments(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", label: Column | None = None, min_sentences: int = 2, sure: float = 0.6) -> DataFrame:
    """id, label, seg_start, seg_end, lang, confidence, n_sentences, in_doc, doc_conf: runs of sentences of one language.

    ``in_doc``: the language belongs to the document. The model is of fixed size and travels with the function.
    """
    src = docs.select(F.col(id_col), F.col(text_col).alias("_t"), (label if label is not None else F.lit(None).cast("string")).alias("label"))
    box = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = box.value
        for b in batches:
            per = [sentences(t) for t in b["_t"]]
            p = m.predict([s[2] for x in per for s in x])
            rows, at = [], 0
            for i, lab, ss in zip(b[id_col], b["label"], per):
                q = p[at : at + len(ss)]
                at += len(ss)
                if len(ss):
                    rows += [(i, lab, *r) for r in decide(ss, q, m.codes, min_sentences, sure)]
            yield pd.DataFrame(rows, columns=[id_col, "label", "seg_start", "seg_end", "lang", "confidence", "n_sentences", "in_doc", "doc_conf"])

    kind = dict(src.dtypes)[id_col]
    return spread(src).mapInPandas(run, f"{id_col} {kind}, label string, seg_start int, seg_end int, lang string, confidence double, n_sentences int, in_doc boolean, doc_conf double")


def decide(ss: list[tuple[int, int, str]], p: np.ndarray, codes: list[str], min_sentences: int, sure: float) -> list[tuple]:
    """Segments of one document from its sentences' probabilities."""
    k = p.shape[1]
    best, conf = p.argmax(axis=1), p.max(axis=1)
    count = np.bincount(best[conf >= sure], minlength=k)
    size = np.array([len(s[2]) for s in ss], float)
    mean = (p * size[:, None]).sum(axis=0) / size.sum()
    inside = count >= min_sentences
    if not inside.any():
        inside = np.arange(k) == mean.argmax()
    # a sentence whose language is not one of the document's joins the most probable one that is
    own = np.where(inside[best], best, np.where(conf >= sure, best, (p * inside).argmax(axis=1)))
    out, i = [], 0
    while i < len(ss):
        j = i
        while j < len(ss) and own[j] == own[i]:
            j += 1
        c = own[i]
        sel = own == c
        doc_conf = float((p[sel, c] * size[sel]).sum() / size[sel].sum())
        out.append((ss[i][0], ss[j - 1][1], codes[c], float(p[i:j, c].mean()), j - i, bool(inside[c]), doc_conf))
        i = j
    if inside.sum() == 1 and not any(r[5] for r in out):  # all sentences unsure of different languages
        c = int(inside.argmax())
        out = [(ss[0][0], ss[-1][1], codes[c], float(mean[c]), len(ss), True, float(mean[c]))]
    return out


def document_languages(segs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, label, lang, confidence, n_sentences, n_langs: a row per language of each document."""
    inside = segs.where("in_doc").groupBy(id_col, "label", "lang").agg(F.max("doc_conf").alias("confidence"), F.sum("n_sentences").alias("n_sentences"))
    n = inside.groupBy(id_col, "label").agg(F.count("*").alias("n_langs"))
    return inside.join(n.withColumnRenamed("label", "_l"), id_col).where(F.col("label").eqNullSafe(F.col("_l"))).drop("_l")


def wrong_labels(langs: DataFrame) -> DataFrame:
    """Rows of documents whose label is missing or wrong, or whose text is mixed."""
    return langs.where(F.col("label").isNull() | (F.col("label") != F.col("lang")) | (F.col("n_langs") > 1))
