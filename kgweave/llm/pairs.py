"""Broken prompt and response pairs: token alignment of the two sides and against refusal templates.

Copies: the response's five-word shingles are contained in the prompt's, and the longest common subsequence leaves next
to nothing over. Refusals: sentences align with a template of their language and nothing of substance stands beside them.
Language: both sides go through the language filter. Truncation: what ends without a mark is judged by the corpus itself,
by how often the last words end a sentence there.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgweave.llm.language import LanguageModel, plain, sentences
from kgweave.runtime import Scratch, heavy_keys, join_unique

SHINGLE = 5
#: Share of the response that must align with the prompt, and the prompt with the response, for a copy.
COPY_SHARE = 0.9
#: Words beside a refusal (greetings, referrals) that do not make an answer.
ASIDE_WORDS = 14
#: Share of a template's words that must align, in order.
TEMPLATE_SHARE = 0.85

#: A stretch of words ends a sentence if it does so in this share of its uses; unmarked whole sentences lower the share.
END_SHARE = 0.35

# How refusals are worded, without accents; "|" separates templates.
REFUSALS = {
    "en": "i can t help with|i cannot help with|i can t assist with|i cannot assist with|i can t answer|i cannot answer|i m unable to answer|i am unable to answer|i m unable to help|"
    "i am unable to help|i m not able to answer|i am not able to help|i have to decline|i must decline|i decline to answer|i won t go into that|i will not go into that|i would rather not comment|"
    "i d rather not|not something i may discuss|not something i can discuss|no details can be shared|outside of what i am allowed to|i am not allowed to|i m not permitted to|i refuse to answer|i won t answer",
    "de": "kann ich nicht helfen|kann ich nicht weiterhelfen|kann ich nicht beantworten|muss ich ablehnen|ich muss ablehnen|darf ich keine auskunft geben|ich darf keine auskunft geben|bin ich zu keiner antwort befugt|"
    "ich kann dabei nicht helfen|ich kann das nicht beantworten|dazu darf ich nichts sagen",
    "fr": "je ne peux pas repondre a cette|je ne peux pas vous aider|je ne peux pas aider|il m est impossible d aider|il m est impossible de repondre|je ne suis pas autorise a en parler|je dois refuser|"
    "je ne suis pas en mesure de repondre|je prefere ne pas repondre",
    "es": "no puedo ayudar con|no puedo ayudarle con|no puedo responder a|debo rechazar esta|tengo que rechazar esta|no me esta permitido hablar|no estoy autorizado a|prefiero no responder",
    "pt": "nao posso ajudar com|nao posso responder a|preciso recusar essa|tenho de recusar essa|nao tenho permissao para falar|nao estou autorizado a|prefiro nao responder",
    "it": "non posso aiutare con|non posso rispondere a|devo rifiutare questa|non mi e permesso parlarne|non sono autorizzato a|preferisco non rispondere",
    "nl": "kan ik niet bij helpen|kan ik niet mee helpen|ik kan daar niet bij helpen|deze vraag moet ik afwijzen|ik moet deze vraag afwijzen|daarover mag ik niets zeggen|daar mag ik niets over zeggen|ik kan deze vraag niet beantwoorden",
}
# Words that stand for a missing answer, and the labels that may come before one.
NOTHING = {"", "null", "none", "nil", "n a", "na", "nan", "undefined", "no output", "no answer", "no response", "empty", "answer", "a", "response", "summary", "q", "q a", "answer a", "tbd"}
# Names of the languages, without accents, in each of them.
NAMES = {
    "en": "english englisch anglais ingles inglese engels",
    "de": "german deutsch allemand aleman alemao tedesco duits",
    "fr": "french franzosisch francais frances francese frans",
    "es": "spanish spanisch espagnol espanol espanhol spagnolo spaans castellano",
    "pt": "portuguese portugiesisch portugais portugues portoghese portugees",
    "it": "italian italienisch italien italiano italiaans",
    "nl": "dutch niederlandisch neerlandais neerlandes holandes olandese nederlands hollandisch",
}
_NAME = {w: code for code, ws in NAMES.items() for w in ws.split()}
_ASKS = re.compile(r"answer|repl(y|ies)|respon[ds]|antwor|antwoor|repond|rispond|write|schreib|ecri|escrib|escrev|scriv|schrijf|translat|ubersetz|tradui|traduc|traduz|tradu[rc]|vertaal")
_TOKEN = re.compile(r"`[^`\n]*`|\d+(?:[.,]\d+)*|(?:[^\W\d_][̀-ͯ]*)+")
_WORD = re.compile(r"(?:[^\W_][̀-ͯ]*)+")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_ENDS = re.compile(r"[.!?。]+[\"'”»’)\]*_]*$|[.!?]`$")
_SENTENCE = re.compile(r"[.!?]+[\"'”»’)]*(?=\s|$)|\n+")
_TEMPLATES = [t.split() for ts in REFUSALS.values() for t in ts.split("|")]
#: word -> [(template, times in it)]
_TEMPLATES_OF: dict[str, list[tuple[int, int]]] = {}
for _k, _t in enumerate(_TEMPLATES):
    for _w, _n in Counter(_t).items():
        _TEMPLATES_OF.setdefault(_w, []).append((_k, _n))


def norm(text: str) -> list[str]:
    return [plain(w) for w in _WORD.findall(text)]


def tokens(text: str) -> list[str]:
    """Lower-case words, with identifiers in backticks and numbers masked."""
    return ["`" if w[0] == "`" else "0" if w[0].isdigit() else plain(w) for w in _TOKEN.findall(text)]


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence: a row of the table is one number of len(a) bits, a zero for each step up."""
    places: dict[str, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    full = row = (1 << len(a)) - 1
    for y in b:
        met = row & places.get(y, 0)
        row = (row + met | row - met) & full
    return len(a) - row.bit_count()


def _shingles(words: list[str]) -> set:
    return {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)} or {tuple(words)}


def is_copy(question: list[str], answer: list[str]) -> bool:
    """Nothing but the question again, once or more, with labels like Q: and A: or none."""
    answer = [w for w in answer if w not in ("q", "a", "question", "answer") or w in question]
    if len(question) < 2 or len(answer) < COPY_SHARE * len(question):
        return False
    mine, theirs = _shingles(answer), _shingles(question * 2)
    if len(mine & theirs) < 0.5 * len(mine):
        return False
    if len(answer) > 1.5 * len(question):  # several times over: each stretch of the question's length aligns
        parts = [answer[i : i + len(question)] for i in range(0, len(answer), len(question))]
        if len(parts[-1]) < 0.5 * len(question):
            parts[-2:] = [parts[-2] + parts[-1]]
    else:
        parts = [answer]
    return all(lcs(question, p) >= COPY_SHARE * max(len(p), min(len(question), len(p))) for p in parts)


def _refuses(words: list[str]) -> bool:
    """A sentence aligns with a template: nearly all its words in order, within a stretch not much longer."""
    met: Counter = Counter()
    for w in set(words):
        for k, n in _TEMPLATES_OF.get(w, ()):
            met[k] += n
    for k, n in met.items():
        t = _TEMPLATES[k]
        need = TEMPLATE_SHARE * len(t)
        if n < need or len(words) < need:
            continue
        for s in range(max(1, len(words) - len(t) + 1)):
            if lcs(t, words[s : s + len(t) + 1]) >= need:
                return True
    return False


def is_refusal(question: list[str], text: str) -> bool:
    asked = set(question)
    parts = [norm(p) for p in _SENTENCE.split(text)]
    # a repeated prompt is no answer; few sentences share enough words for the alignment to be worth it
    parts = [p for p in parts if p and not (len(p) >= 3 and sum(w in asked for w in p) >= COPY_SHARE * len(p) and lcs(question, p) >= COPY_SHARE * len(p))]
    no = [_refuses(p) for p in parts]
    return any(no) and sum(len(p) for p, x in zip(parts, no) if not x) <= ASIDE_WORDS


def is_empty(text: str | None) -> bool:
    return text is None or " ".join(norm(_INVISIBLE.sub("", text))) in NOTHING


def ending(text: str) -> str:
    """'whole', 'cut', or 'open' where only the words can tell."""
    t = _INVISIBLE.sub("", text).rstrip()
    if t.count("```") % 2:
        return "cut"
    if t.endswith("```"):
        return "whole"
    if re.search(r"(\.\.\.|…)[\"'”»)]*$", t):
        return "cut"
    last = t.rsplit("\n", 1)[-1].strip()
    if last.replace("```", "").count("`") % 2 or re.fullmatch(r"(?:[-*+•]|\d+[.)])", last):
        return "cut"
    if _ENDS.search(t):
        return "whole"
    if re.fullmatch(r"(?:[-*+•]|\d+[.)])\s+(`[^`]+`|\S+)", last) or re.search(r"[)\]}>|*_]$", t):
        return "whole"
    return "cut" if re.search(r"[,;:(\[{\-–—/\"“«=+&]$", t) else "open"


def _tails(words: list[str], k: int) -> list[str]:
    """What a sentence stops at after its k-th word, from vague to exact: the last one, two and three words, the last five
    with any word at the end, the last four and five."""
    out = [words[k - 1]]
    if k > 1:
        out.append(f"{words[k - 2]} {out[-1]}")
    if k > 2:
        out.append(f"{words[k - 3]} {out[-1]}")
    if k > 3:
        four = f"{words[k - 4]} {out[-1]}"
        if k > 4:
            out += [f"{words[k - 5]} {words[k - 4]} {words[k - 3]} {words[k - 2]} *", four, f"{words[k - 5]} {four}"]
        else:
            out.append(four)
    return out


def _key(tail: str) -> int:
    return xxhash.xxh64_intdigest(tail) - (1 << 63)


def _grams(words: list[str]) -> list[int]:
    return [_key(t) for t in _tails(words, len(words))]


def languages(model: LanguageModel, text: str) -> Counter:
    return Counter(x for _, _, w in sentences(text) if (x := model.language(w)[0]))


def asked_for(question: str) -> set[str]:
    """Languages that the prompt asks the response to be in."""
    out = set()
    for s in _SENTENCE.split(question):
        words = norm(s)
        named = {_NAME[w] for w in words if w in _NAME}
        if named and _ASKS.search(" ".join(words)):
            out |= named
    return out


def in_other_language(model: LanguageModel, question: str, answer: str) -> bool:
    theirs = languages(model, answer)
    if not theirs:
        return False
    mine = languages(model, question)
    allowed = {mine.most_common(1)[0][0]} if mine else set()
    return bool(allowed) and not (allowed | asked_for(question)) & theirs.keys()


def judge(model: LanguageModel, question: str | None, answer: str | None) -> tuple[str | None, list[int] | None]:
    """(defect, keys of the last words where they decide whether it is truncated instead)."""
    if is_empty(answer):
        return "empty", None
    question = question or ""
    q = norm(question)
    if is_copy(q, norm(answer)):
        return "copy", None
    if is_refusal(q, answer):
        return "refusal", None
    end = ending(answer)
    if end == "cut":
        return "truncated", None
    rest = "language" if in_other_language(model, question, answer) else None
    if end == "open":
        words = tokens(re.split(r"[.!?]\s+|\n+", _INVISIBLE.sub("", answer).rstrip())[-1])
        return rest, _grams(words) if words else None
    return rest, None


def _counted(text: str, counts: dict) -> None:
    """Adds the text's stretches of words: how often they occur, and how often they end a sentence that has a mark."""
    start = 0
    for m in [*_SENTENCE.finditer(text), None]:
        words = tokens(text[start : m.start() if m else len(text)])
        marked = bool(m) and m[0][0] in ".!?"
        for k in range(1, len(words) + 1):
            ends = marked and k == len(words)
            for g in _tails(words, k):
                x = counts.get(g)
                if x is None:
                    counts[g] = [1, int(ends)]
                else:
                    x[0] += 1
                    if ends:
                        x[1] += 1
        start = m.end() if m else len(text)


def ending_counts(texts: DataFrame) -> DataFrame:
    """key, n, ends of every stretch of up to five words in the column ``text``; combined before the shuffle."""

    def run(batches):
        counts: dict[str, list[int]] = {}

        def out():
            return pd.DataFrame({"key": [_key(t) for t in counts], "n": [x[0] for x in counts.values()], "ends": [x[1] for x in counts.values()]}, columns=["key", "n", "ends"]).astype("int64")

        for pdf in batches:
            for text in pdf["text"]:
                if text:
                    _counted(text, counts)
                    if len(counts) > 300_000:
                        yield out()
                        counts.clear()
        yield out()

    return texts.select("text").mapInPandas(run, "key bigint, n bigint, ends bigint").groupBy("key").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))


def broken_pairs(conversations: DataFrame, model: LanguageModel, min_seen: int = 3) -> DataFrame:
    """conv_id, defect: each distinct (id, defect) among the pairs of ``question`` and ``summary``.

    A null summary is empty. A null question copies nothing and has no language. Null ids are kept. Repeated pairs
    give one row; a pair has one defect, the first of empty, copy, refusal, truncated, language.
    """
    scratch = Scratch(conversations.sparkSession)
    shared = conversations.sparkSession.sparkContext.broadcast(model.slots)

    def run(batches):
        own = LanguageModel(shared.value).finish()
        for pdf in batches:
            rows = []
            for conv_id, q, a in zip(pdf["id"], pdf["question"], pdf["summary"]):
                defect, keys = judge(own, q, a)
                if defect or keys:
                    rows.append((conv_id, defect, keys))
            yield pd.DataFrame(rows, columns=["conv_id", "defect", "keys"])

    judged = scratch.save(conversations.select("id", "question", "summary").mapInPandas(run, "conv_id string, defect string, keys array<bigint>"))
    sure = judged.where(F.col("keys").isNull()).select("conv_id", "defect")
    open_rows = judged.where(F.col("keys").isNotNull()).distinct()
    texts = conversations.select(F.explode(F.array("question", "summary")).alias("text"))
    asked = open_rows.select("conv_id", "defect", F.xxhash64("keys").alias("row"), F.posexplode("keys").alias("at", "key"))
    counts = ending_counts(texts).join(asked.select("key").distinct(), "key", "left_semi")
    met = join_unique(asked, counts, "key", "left", heavy_keys(asked, "key"))
    # the row's own ending counts once in n; the most exact stretch seen often enough decides
    seen = F.coalesce(F.col("n"), F.lit(0)) - 1 >= min_seen
    exact = F.struct("at", (F.col("ends") / F.greatest(F.col("n") - 1, F.lit(1))).alias("share"))
    best = met.groupBy("conv_id", "defect", "row").agg(F.max(F.when(seen, exact)).alias("x"), F.max(F.when(F.col("at") == 0, F.col("n"))).alias("word"))
    decided = best.select("conv_id", F.when((F.coalesce(F.col("word"), F.lit(0)) < 2) | (F.coalesce(F.col("x.share"), F.lit(0.0)) < END_SHARE), F.lit("truncated")).otherwise(F.col("defect")).alias("defect"))
    return sure.unionByName(decided).where(F.col("defect").isNotNull()).distinct()
