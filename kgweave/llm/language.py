"""Missing or wrong language labels and mixed-language texts: language-bitmask n-gram filters.

A bit-sliced Bloom filter holds the n-grams of all languages at once: each slot is a bit mask of languages, and the AND
of an n-gram's slots is the set of languages that contain it. A sentence's n-grams are looked up, the set bits counted per
language, and each count corrected for its slice's false-positive rate; the corrected counts decide. Runs of sentences
make segments. The filter is fitted on a bounded sample of labelled rows and has a fixed size; every document is scored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGS = ("en", "de", "fr", "es", "pt", "it", "nl")
# Label forms that name each language (two- and three-letter codes, English names).
LABELS = {
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german"),
    "fr": ("fr", "fra", "fre", "french"),
    "es": ("es", "spa", "spanish"),
    "pt": ("pt", "por", "portuguese"),
    "it": ("it", "ita", "italian"),
    "nl": ("nl", "nld", "dut", "dutch"),
}
# Frequent function words, a floor under the fitted n-grams.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for on are with as at be this have from or by not but what when which their there would about other into than then only these after before where because while should could",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um noch wie einem über so zum kann nur sind wenn oder aber vor zur bis mehr durch",
    "fr": "le la les de des et un une du en est que qui dans pour pas au sur ne se par plus avec ce il sont mais cette nous vous ou son leur sans aux été comme tout fait être si même aussi leurs dont",
    "es": "el la los las de que y en un una del se por con no para es al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante",
    "pt": "o a os as de que e do da em um uma para com não por mais dos das como mas foi ao ele se tem à seu sua ou quando muito nos já também só pelo pela até isso entre depois sem mesmo aos são",
    "it": "il lo la i gli le di che e un una del della in per non con è da si sono come anche più dei nel al ma alla dal se ha delle questo o tra cui dopo senza quando essere sul nella degli perché",
    "nl": "de het een van en in is dat op te zijn met voor niet aan er om ook als dan maar bij nog uit naar heeft hij ze wordt door over deze worden of kan meer geen zo wel had tot moet veel na alle dit",
}
#: Labelled documents a language that the filter is fitted on, about; the bound of the sample is twice this.
FIT_DOCS = 500
#: Slots of the filter and hash functions an n-gram.
SLOTS, HASHES, N = 1 << 20, 3, 4
#: Words of a natural sentence, and the share of its n-grams that its language must contain.
MIN_WORDS, MIN_SHARE = 4, 0.55

_FENCE = re.compile(r"(```|~~~).*?(?:\1|\Z)", re.S)
_HEADING = re.compile(r"^[ \t]*#{1,6}[^\n]*|^[^\n]+\n[ \t]*(?:={3,}|-{3,})[ \t]*$", re.M)
_SPANS = re.compile(r"`[^`\n]*`|https?://\S+|<[^<>\n]{1,200}>|\(\s*[\"“«„][^\"”»“\n]{0,120}[\"”»“]\s*\)|[\"“«„][^\"”»“\n.!?]{0,120}[\"”»“]")
_NAMES = re.compile(
    r"\b\w+(?:[_/\\]\w+)+(?:\.\w+)*\b|\b\w*[a-z]\w*[A-Z]\w*\b|\b\w+(?:\.\w+)*\(\)|\b\w+\.(?:py|js|ts|go|rs|java|hs|md|json|ya?ml|txt|sh)\b|\$\{?\w+\}?|--\w[\w-]*"
)
#: What any identifier, path or option shows, each sought by its rarest character; most texts keep theirs in backticks and
#: need no second pass.
_NAMED = (re.compile(r"[_/\\$]"), re.compile(r"\.(?=[a-z]{2})"), re.compile(r"[A-Z](?<=[^\WA-Z][A-Z])"), re.compile(r"\(\)|--\w"))
_BULLET = re.compile(r"^[ \t]*(?:[-*+•]|\d+[.)]|>)[ \t]+", re.M)
_BREAK = re.compile(r"[.!?…]+[\"”»)’']*(?=\s|\Z)|\n[ \t]*\n|\n(?=[ \t]*(?:[-*+•>]|\d+[.)])[ \t])|(?<=[:;])\n")
_ASCII_LETTERS = re.compile(r"[a-z]+")
_LETTERS = re.compile(r"[^\W\d_]+(?:[̀-ͯ�]+[^\W\d_]*)*")
_MOJIBAKE = re.compile("[ÂÃ][-¿ŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™]")


def label_language(c: Column) -> Column:
    """The two-letter code a label names, else null. Case, outer blanks and a region after - or _ do not matter."""
    base = F.regexp_extract(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"^([a-z]+)(?:[-_][a-z0-9]+)*$", 1)
    out = F.lit(None).cast("string")
    for code, forms in LABELS.items():
        out = F.when(base.isin(*forms), F.lit(code)).otherwise(out)
    return out


def _repair(m: re.Match) -> str:
    """A twice-encoded letter, with a joiner so that positions stay."""
    for codec in ("cp1252", "latin-1"):
        try:
            return m[0].encode(codec).decode("utf-8") + "͏"
        except UnicodeError:
            pass
    return m[0]


def plain(word: str) -> str:
    """Lower case without accents, so that decomposed and damaged forms agree."""
    return word.lower() if word.isascii() else _unaccented(word)


@lru_cache(maxsize=100_000)
def _unaccented(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c)).replace("�", "")


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of the sentences of a text; code, headings, quoted phrases and identifiers are left out."""
    blank = lambda m: " " * len(m[0])
    keep = lambda m: re.sub(r"[^\n]", " ", m[0])
    t = _MOJIBAKE.sub(_repair, text) if "Ã" in text or "Â" in text else text
    t = _HEADING.sub(lambda m: keep(m)[:-1] + "\n" if not m[0].endswith("\n") and m[0] else keep(m), _FENCE.sub(keep, t)) if "#" in t or "`" in t or "~" in t or "--" in t or "==" in t else t
    t = _SPANS.sub(blank, t)
    if any(x.search(t) for x in _NAMED):
        t = _NAMES.sub(blank, t)
    ascii_only, low = t.isascii(), t.lower()
    if len(low) != len(t):  # a letter whose lower case is longer
        low = t
    out, start = [], 0
    for m in [*_BREAK.finditer(t), None]:
        end = m.end() if m else len(t)
        words = _ASCII_LETTERS.findall(low, start, end) if ascii_only else [w if w.isascii() and low is not t else plain(w) for w in _LETTERS.findall(low, start, end)]
        if words:
            out.append((start, min(end, len(text)), words))
        start = end
    return out


def _grams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w, *(w[i : i + N] for i in range(len(w) - N + 1))] if len(w) > N else [w]


class _Words(dict):
    """word -> its packed counts, forgotten when there are too many."""

    def __init__(self, model: "LanguageModel"):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = out = self.model._word(word)
        return out


@dataclass
class LanguageModel:
    """A bit-sliced Bloom filter over the n-grams of LANGS."""

    slots: np.ndarray = field(default_factory=lambda: np.zeros(SLOTS, dtype=np.uint8))

    def __post_init__(self):
        self._words = _Words(self)

    @staticmethod
    def _at(gram: str) -> list[int]:
        h = xxhash.xxh64_intdigest(gram)
        a, b = h & 0xFFFFFFFF, (h >> 32) | 1
        return [(a + i * b) % SLOTS for i in range(HASHES)]

    def add(self, gram: str, mask: int) -> None:
        for i in self._at(gram):
            self.slots[i] |= mask

    def finish(self) -> "LanguageModel":
        bits = (self.slots[:, None] >> np.arange(len(LANGS))) & 1
        self.false_rate = tuple(float(x) for x in bits.mean(axis=0) ** HASHES)
        self._words.clear()
        return self

    def mask(self, gram: str) -> int:
        a, b, c = self._at(gram)
        return int(self.slots[a] & self.slots[b] & self.slots[c])

    def _word(self, word: str) -> int:
        """The word's n-grams and, per language, how many it contains, as 32-bit fields of one number."""
        grams = _grams(word)
        packed = len(grams)
        for g in grams:
            m, k = self.mask(g), 32
            while m:
                packed += (m & 1) << k
                m, k = m >> 1, k + 32
        return packed

    def scores(self, words: list[str]) -> tuple[int, list[float]]:
        """n-grams looked up, and per language those it contains, corrected for false positives."""
        total = sum(map(self._words.__getitem__, words))
        n = total & 0xFFFFFFFF
        hits = [total >> 32 * (k + 1) & 0xFFFFFFFF for k in range(len(LANGS))]
        return n, [max(0.0, (h - n * f) / (1 - f)) if f < 1 else 0.0 for h, f in zip(hits, self.false_rate)]

    def language(self, words: list[str]) -> tuple[str | None, float]:
        """(language, confidence); no language for what is no natural sentence. Confidence is the best corrected share times its lead."""
        if len(words) < MIN_WORDS:
            return None, 0.0
        n, c = self.scores(words)
        second, top = sorted(c)[-2:]
        if top < MIN_SHARE * n:
            return None, 0.0
        lead = 1 - second / top
        return (LANGS[c.index(top)], min(1.0, top / n) * min(1.0, 0.5 + lead)) if lead > 0.02 else (None, 0.0)


def _build(counts: dict[str, Counter], share: float) -> LanguageModel:
    model = LanguageModel()
    totals = {k: max(1, sum(c.values())) for k, c in counts.items()}
    rates: dict[str, dict[int, float]] = defaultdict(dict)
    for code, c in counts.items():
        for g, n in c.items():
            if n >= 2:
                rates[g][LANGS.index(code)] = n / totals[code]
    for g, by in rates.items():
        top = max(by.values())
        model.add(g, sum(1 << k for k, r in by.items() if r >= share * top))
    for k, code in enumerate(LANGS):
        for w in FUNCTION_WORDS[code].split():
            for g in _grams(plain(w))[:1]:
                model.add(g, 1 << k)
    return model.finish()


def fit(documents: DataFrame, docs_per_language: int = FIT_DOCS) -> LanguageModel:
    """Fit on about ``docs_per_language`` labelled documents a language (chosen by a hash of id and text), twice that at most.

    Labels may be wrong and texts mixed: an n-gram belongs to a language only if it is frequent there relative to the
    language where it is most frequent, and a second fit uses just the sentences that the first finds rightly labelled.
    """
    rows = documents.select(F.xxhash64("doc_id", "text").alias("h"), label_language(F.col("lang")).alias("code"), "text").where("code is not null and text is not null")
    sizes = {r[0]: r[1] for r in rows.groupBy("code").count().collect()}
    chosen = F.lit(False)
    for code, n in sorted(sizes.items()):
        share = min(1.0, docs_per_language / n)
        chosen = chosen | ((F.col("code") == code) & (F.pmod("h", F.lit(1_000_003)) <= int(1_000_003 * share)))
    texts: dict[str, list[list[list[str]]]] = {code: [] for code in sorted(sizes)}
    # one scan for all languages; whole texts. The hash's share bounds the sample, the limit only guards against equal rows
    sample = rows.where(chosen).limit(2 * docs_per_language * len(LANGS)).select("h", "code", "text").collect()
    for _, code, text in sorted(map(tuple, sample)):
        if len(texts[code]) < 2 * docs_per_language:
            texts[code].append([x[2] for x in sentences(text)])
    return fit_sentences(texts)


def fit_sentences(texts: dict[str, list[list[list[str]]]]) -> LanguageModel:
    def counted(keep) -> dict[str, Counter]:
        out = {}
        for code, docs in texts.items():
            seen: Counter = Counter()
            for doc in docs:
                for words in doc:
                    if keep(code, words):
                        seen.update(words)
            c: Counter = Counter()
            for w, n in seen.items():
                for g in _grams(w):
                    c[g] += n
            out[code] = c
        return out

    first = _build(counted(lambda code, words: len(words) >= MIN_WORDS), 0.25)
    return _build(counted(lambda code, words: first.language(words)[0] == code), 0.05)


def _mean(values: list[float]) -> float:
    return sum(values) / len(values)


def label_text(model: LanguageModel, text: str | None) -> list[tuple[int, str | None, float, int, int, int]]:
    """[(segment, language, confidence, sentences, start, end)]: segment 0 is the whole text's main language, then the runs.

    A sentence that is no natural one neither makes nor breaks a run. A run of one sentence between or beside others is
    joined to its neighbour, as single foreign phrases count for nothing.
    """
    if not text:
        return []
    found = [(s, e, *model.language(w), len(w)) for s, e, w in sentences(text)]
    found = [x for x in found if x[2]]
    if not found:
        return []
    runs: list[list] = []  # language, confidences, start, end
    for s, e, lang, conf, _ in found:
        if runs and runs[-1][0] == lang:
            runs[-1][1].append(conf)
            runs[-1][3] = e
        else:
            runs.append([lang, [conf], s, e])
    if len(runs) > 1:
        long = [r for r in runs if len(r[1]) > 1]
        if long:
            joined: list[list] = []
            for r in runs:
                if len(r[1]) > 1 and not (joined and joined[-1][0] == r[0]):
                    joined.append([r[0], list(r[1]), r[2], r[3]])
                elif joined:
                    joined[-1][3] = r[3]
                    if joined[-1][0] == r[0]:
                        joined[-1][1] += r[1]
            runs = joined
        else:  # single sentences only: the language of most, the first of equals
            votes = Counter(r[0] for r in runs)
            main = max(votes, key=lambda k: votes[k])
            runs = [[main, [c for r in runs if r[0] == main for c in r[1]], runs[0][2], runs[-1][3]]]
    total: dict[str, list[float]] = defaultdict(list)
    for lang, conf, _, _ in runs:
        total[lang] += conf
    main = max(total, key=lambda k: (len(total[k]), k))
    out = [(0, main, _mean(total[main]), sum(map(len, total.values())), 0, len(text))]
    return out + [(k, r[0], _mean(r[1]), len(r[1]), r[2], r[3]) for k, r in enumerate(runs, 1)]


def label_segments(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, label, segment, found_lang, confidence, sentences, start, end.

    Segment 0 is the document with its main language; 1, 2, ... are its runs of sentences of one language, as character
    ranges. Documents without a natural sentence (null, empty, code only) get segment 0 with null language, confidence 0.
    Works row by row on whole texts, so nothing is shuffled and repeated rows are repeated in the result.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model.slots)

    def run(batches):
        own = LanguageModel(shared.value).finish()
        for pdf in batches:
            rows = []
            for doc_id, label, text in zip(pdf["doc_id"], pdf["label"], pdf["text"]):
                for x in label_text(own, text) or [(0, None, 0.0, 0, 0, len(text or ""))]:
                    rows.append((doc_id, label, *x))
            yield pd.DataFrame(rows, columns=["doc_id", "label", "segment", "found_lang", "confidence", "sentences", "start", "end"])

    rows = documents.select("doc_id", label_language(F.col("lang")).alias("label"), "text")
    return rows.mapInPandas(run, "doc_id bigint, label string, segment int, found_lang string, confidence double, sentences int, start int, end int")


def relabelled(segments: DataFrame) -> DataFrame:
    """doc_id, found_lang of documents whose label is missing or wrong or that hold several languages."""
    rows = segments.where(F.col("found_lang").isNotNull()).groupBy("doc_id").agg(
        F.first("label", ignorenulls=True).alias("label"),
        F.max(F.when(F.col("segment") == 0, F.col("found_lang"))).alias("main"),
        F.collect_set("found_lang").alias("langs"),
    )
    case = F.col("label").isNull() | (F.col("label") != F.col("main")) | (F.size("langs") > 1)
    return rows.where(case).select("doc_id", F.explode("langs").alias("found_lang"))
