"""Broken question-answer pairs, by a multi-label linear classifier trained on synthetic defects (problem 1).

A bounded sample of the pairs, mostly sound, gives the negatives. Positives are made from it: answers cut at a
random place, replaced by the question or a slight change of it, swapped with an answer in another language, emptied, or
replaced by refusals put together from stock phrases, which no feature knows; short sound answers are made as negatives. Features are hashed word n-grams (of the whole answer, its
first words and its last words, and of short answers as a whole) and graded pair features: overlap both ways, shares in other languages, amounts, the end.
One of the pair features is the corpus-wide trigram evidence that the answer was cut. Pairs of the sample that the first fit
finds defective no longer count as sound in the second. Thresholds are set on a held-out third.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemesh.llm import cutoff
from passagemesh.llm.sentences import STOPWORDS, language, script, units
from passagemesh.runtime import materialize

DEFECTS = ["empty", "truncated", "refusal", "copies_question", "wrong_language"]
#: Bound of the sample the classifier is fitted on, in pairs; hashed features; training steps.
SAMPLE, BUCKETS, STEPS = 3000, 1 << 16, 150
SEED = 1
#: Thresholds that are tried; F1 scores that differ by less are alike.
GRID, TIE = [round(0.02 * k, 2) for k in range(2, 49)], 0.003
#: Parts of the sample, each judged by units fitted on the others; the score from which a pair is no example of a defect's absence; training steps of those units.
FOLDS, DOUBT, FOLD_STEPS = 3, 0.3, 150

# What stands for no content.
PLACEHOLDERS = {"null", "none", "nil", "n/a", "na", "nan", "tbd", "todo", "undefined", "unknown", "empty", "<empty>", "(no answer)", "no answer", "(none)", "[]", "{}", '""', "''", "-", "--", "—", "...", "…", "<null>", "[empty]", "(empty)", "\\n", "no content", "(blank)", "blank"}
# Stock phrases of refusals: openings, cores and closings in English, whole ones in other languages.
OPENINGS = ["", "Sorry,", "I'm sorry, but", "I am sorry.", "I am sorry, but", "Apologies, but", "Unfortunately,", "Thank you for the question; however,", "As an assistant,", "As an AI language model,", "I apologize, but", "Regrettably,"]
CORES = ["I cannot answer this question", "I can't help with that", "I can’t answer that", "I am unable to assist with this request", "I'm not able to answer this", "I must decline to answer", "I'd rather not comment on this topic", "answering this would go against my guidelines", "my instructions do not let me give an answer here", "it is not possible for me to respond to this", "I have no way of answering that from the given passages", "no answer will be given by me on this", "I don't feel comfortable responding", "I do not have enough information to answer", "I won't be able to provide that", "I do not know the answer", "this is outside what I may discuss", "I have to refuse this request", "I'm not able to provide an answer", "this is not something I can talk about"]
CLOSINGS = ["", "", "", "about {name}", "because the material is outside what I may discuss", "as the context does not contain it", "at this time"]
AFTER = ["", "", "", "Please consult a specialist.", "Is there anything else you would like to know?", "The question about this is one for others."]
REFUSALS = {
    "de": ["Diese Frage kann ich leider nicht beantworten.", "Das geht über meine Möglichkeiten hinaus.", "Es tut mir leid, aber dazu kann ich nichts sagen.", "Leider kann ich dabei nicht helfen.", "Ich möchte mich dazu nicht äußern.", "Tut mir leid, darauf darf ich nicht antworten."],
    "fr": ["Je suis désolé, mais je ne peux pas répondre à cette question.", "Il m'est impossible de traiter cette demande.", "Désolé, ce sujet sort de ce que je peux aborder.", "Je préfère ne pas répondre.", "Je ne suis pas en mesure de vous aider."],
    "es": ["Lo siento, pero no puedo responder a esa pregunta.", "No me es posible ayudar con esta solicitud.", "Disculpa, esa consulta queda fuera de mi alcance.", "Prefiero no opinar sobre este tema.", "Lamento no poder ayudar con eso."],
    "ru": ["К сожалению, я не могу ответить на этот вопрос.", "На такие вопросы я не отвечаю.", "Извините, но помочь с этим я не могу.", "Это выходит за рамки моих возможностей.", "Я вынужден отказаться от ответа."],
    "zh": ["抱歉，我无法回答这个问题。", "我不便对此发表意见。", "很遗憾，我不能提供相关帮助。", "对不起，这超出了我的能力范围。"],
    "ja": ["申し訳ありませんが、その質問にはお答えできません。", "この件についてはお手伝いできません。", "恐れ入りますが、回答を控えさせていただきます。", "それにはお答えしかねます。"],
    "ar": ["عذرًا، لا يمكنني الإجابة عن هذا السؤال.", "آسف، لا أستطيع المساعدة في هذا الطلب.", "أعتذر، فهذا الموضوع خارج نطاق ما يمكنني مناقشته.", "يتعذر علي الرد على ذلك."],
    "hi": ["क्षमा करें, मैं इस प्रश्न का उत्तर नहीं दे सकता।", "इस विषय में मैं सहायता करने में असमर्थ हूँ।", "माफ़ कीजिए, मैं इसका जवाब नहीं दे सकता।"],
    "th": ["ขออภัย ฉันไม่สามารถตอบคำถามนี้ได้", "ฉันไม่สามารถช่วยเรื่องนี้ได้", "เสียใจด้วย เรื่องนี้อยู่นอกเหนือสิ่งที่ฉันตอบได้"],
    "el": ["Λυπάμαι, αλλά δεν μπορώ να απαντήσω σε αυτό.", "Δεν είμαι σε θέση να βοηθήσω με αυτό το αίτημα.", "Συγγνώμη, αυτή η ερώτηση είναι εκτός των δυνατοτήτων μου."],
}
# Languages as a question may ask for them.
ASKED = {"english": "en", "german": "de", "french": "fr", "spanish": "es", "russian": "ru", "chinese": "zh", "japanese": "ja", "arabic": "ar", "hindi": "hi", "thai": "th", "greek": "el", "englisch": "en", "deutsch": "de", "französisch": "fr", "spanisch": "es", "russisch": "ru", "anglais": "en", "allemand": "de", "français": "fr", "espagnol": "es", "russe": "ru", "inglés": "en", "alemán": "de", "francés": "fr", "español": "es", "ruso": "ru"}
_REQUEST = re.compile(r"(?i)\b(?:answer|reply|respond|response|write|written|antwort\w*|répon\w*|respuesta|responde\w*|contesta\w*)\b[^.?!]*?\b(?:in|auf|en)\s+(" + "|".join(ASKED) + r")\b")
_UNSPACED = ("zh", "ja", "th")


def expected_language(question: str) -> str:
    """The language a question asks for, else the one it is in ('latin' where its words don't tell)."""
    found = _REQUEST.findall(question)
    return ASKED[found[-1].lower()] if found else language(question, None)


def sure_language(text: str) -> str:
    """The language of a sentence, 'latin' where fewer than two function words of one language tell it."""
    got = language(text, None)
    if got not in STOPWORDS:
        return got
    words = re.findall(r"[^\W\d_]{2,}", text.lower())
    hits = sorted((sum(w in set(v.split()) for w in words), k) for k, v in STOPWORDS.items())
    return hits[-1][1] if hits[-1][0] >= 2 and hits[-1][0] > hits[-2][0] else "latin"


def tokens(text: str) -> list[str]:
    """Lower-case words, or two-character runs of scripts without blanks."""
    low = text.lower()
    if script(low) in _UNSPACED:
        low = re.sub(r"[\W_]+", "", low)
        return [low[i : i + 2] for i in range(len(low) - 1)]
    return re.findall(r"[\w']+", low)


def _grams(text: str) -> set[str]:
    t = tokens(text)
    return {" ".join(t[i : i + 3]) for i in range(max(1, len(t) - 2))}


_QUOTED = re.compile(r"[“«„\"「][^”»“\"」]*[”»“\"」]")


def pair_features(q: str | None, a: str | None, cut: bool) -> list[float]:
    """The dense features of a pair: graded measures of how much there is, how much of either is in the other, and how much is in another language."""
    text = (a or "").strip().strip("​﻿").strip()
    ta, tq = Counter(tokens(text)), Counter(tokens(q or ""))
    na, nq = sum(ta.values()), sum(tq.values())
    letters = sum(c.isalnum() for c in text)
    in_q = sum(n for x, n in ta.items() if x in tq) / na if na else 0.0
    in_a = sum(n for x, n in tq.items() if x in ta) / nq if nq else 0.0
    # what the answer has beyond a few repetitions of the question
    beyond = sum(max(0, n - 4 * tq[x]) for x, n in ta.items()) / nq if nq else 1.0
    rest = sum((ta - tq).values()) / nq if nq else 0.0
    other = known = 0
    if q and letters:
        want = expected_language(q)
        for s, e in units(text):
            piece = text[s:e]
            got = sure_language(_QUOTED.sub(" ", piece))
            if got != "latin" and any(c.isalpha() for c in piece):
                known += e - s
                other += (e - s) if got != want and want != "latin" or want == "latin" and got not in ("en", "de", "fr", "es") else 0
    mixed = other / known if known else 0.0
    ended = bool(re.search(r"[.!?。！？؟।…;][”»\"」』)\]）’']*$", text))
    both = in_q * in_a
    return [float(cut), in_q, in_a, both, both**4, 1 / (1 + 5 * beyond), min(rest, 3.0), mixed, mixed * mixed, float(ended), 1 / (1 + letters), min(1.0, 4 / (1 + na)), both**2 / (1 + 5 * beyond)]


DENSE = 13


def hashed(a: str | None) -> list[int]:
    """Hashed n-grams of an answer: of all its words, of the first and of the last."""
    t = tokens(a or "")
    low = (a or "").strip().lower()
    names = [f"1{x}" for x in t] + [f"2{x} {y}" for x, y in zip(t, t[1:])]
    names += [f"3{x} {y} {z}" for x, y, z in zip(t, t[1:], t[2:])]
    names += [f"f{i}{x}" for i, x in enumerate(t[:4])] + [f"ff{' '.join(t[:n])}" for n in (2, 3)]
    names += [f"l{i}{x}" for i, x in enumerate(reversed(t[-3:]))] + [f"e{low[-n:]}" for n in (1, 2, 3)]
    if len(low) <= 20:  # a short answer as a whole, and the marks around it
        shape = re.sub(r"\w+", "w", low)
        names += [f"w{low}", f"s{shape}", f"b{low.strip('[](){}<>. ')}"]
    return sorted({zlib.crc32(x.encode("utf-8", "replace")) & (BUCKETS - 1) for x in names})


class Classifier:
    """One logistic unit a defect over hashed and dense features, with its threshold."""

    def __init__(self) -> None:
        self.w = np.zeros((BUCKETS, len(DEFECTS)), dtype=np.float32)
        self.d = np.zeros((DENSE, len(DEFECTS)))
        self.b = np.zeros(len(DEFECTS))
        self.at = np.full(len(DEFECTS), 0.5)

    def scores(self, h: list[list[int]], dense: np.ndarray) -> np.ndarray:
        rows = np.repeat(np.arange(len(h)), [len(x) for x in h])
        cols = np.fromiter((c for x in h for c in x), dtype=np.int64)
        z = dense @ self.d + self.b
        if len(cols):
            scale = 1 / np.sqrt(np.maximum([len(x) for x in h], 1))
            for k in range(len(DEFECTS)):
                z[:, k] += np.bincount(rows, self.w[cols, k], minlength=len(h)) * scale
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, h: list[list[int]], dense: np.ndarray, y: np.ndarray, use: np.ndarray, steps: int = STEPS) -> None:
        """Full-batch Adam; ``use`` weighs each pair for each defect. Rare defects weigh as much as their absence up to a factor of 3."""
        rows = np.repeat(np.arange(len(h)), [len(x) for x in h])
        cols = np.fromiter((c for x in h for c in x), dtype=np.int64)
        scale = 1 / np.sqrt(np.maximum(np.array([len(x) for x in h]), 1))
        self.w[:] = 0
        self.d[:] = 0
        self.b[:] = -2
        balance = np.minimum(3, (use * (1 - y)).sum(axis=0) / np.maximum((use * y).sum(axis=0), 1))
        weight = use * np.where(y > 0, balance, 1) / len(h)
        state = [[np.zeros_like(p, dtype=float), np.zeros_like(p, dtype=float)] for p in (self.w, self.d, self.b)]
        for step in range(1, steps + 1):
            g = (self.scores(h, dense) - y) * weight
            gw = np.stack([np.bincount(cols, (g[:, k] * scale)[rows], minlength=BUCKETS) for k in range(len(DEFECTS))], axis=1)
            for p, grad, (m, v), rate in zip((self.w, self.d, self.b), (gw + 1e-6 * self.w, dense.T @ g + 1e-6 * self.d, g.sum(axis=0)), state, (0.1, 0.2, 0.1)):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(p.dtype)

    def calibrate(self, h: list[list[int]], dense: np.ndarray, y: np.ndarray, use: np.ndarray) -> None:
        """Per defect the threshold of the best F1 on these pairs; of those within TIE of it the one nearest to one half."""
        p = self.scores(h, dense)
        for k in range(len(DEFECTS)):
            f1 = []
            for t in GRID:
                hit = p[:, k] >= t
                tp, fp, fn = ((use[:, k] * m).sum() for m in (hit & (y[:, k] > 0), hit & (y[:, k] == 0), ~hit & (y[:, k] > 0)))
                f1.append(2 * tp / max(2 * tp + fp + fn, 1e-9))
            self.at[k] = min((t for t, f in zip(GRID, f1) if f >= max(f1) - TIE), key=lambda t: abs(t - 0.5))


def synthetic(pairs: list[tuple[str, str]], seed: int = SEED) -> list[tuple[str, str, str]]:
    """(question, answer, defect) made from sound (question, answer) pairs."""
    rng = random.Random(seed)
    by_lang: dict[str, list[str]] = {}
    for _, a in pairs:
        by_lang.setdefault(language(a, None), []).append(a)
    langs = sorted(by_lang)
    out = []
    for k, (q, a) in enumerate(pairs):
        kind = k % 6
        if kind == 5:  # sound short answers, so that shortness alone is no defect
            short = re.findall(r"\w[\w' -]{0,20}\w", a)
            if short:
                out.append((q, rng.choice([rng.choice(short).split()[0], rng.choice(short), "Yes", "No", str(rng.randint(0, 2000))]), ""))
            continue
        if kind == 0 and len(a) > 12:
            for _ in range(2):
                cut = a[: rng.randint(max(5, len(a) // 3), len(a) - 2)].rstrip()
                if re.search(r"[.!?。！？؟।…;”»」]$", cut):
                    cut = cut[:-3].rstrip()
                out.append((q, cut + rng.choice(["", "", "", "", "", "...", "…", "�", "\\", " [truncated]", " (cont"]), "truncated"))
        elif kind == 1:
            lang = expected_language(q)
            name = (re.findall(r"\b[A-Z][a-z]+\b", q) or ["this"])[-1]
            made = []
            if lang in REFUSALS:
                made += [" ".join(rng.sample(REFUSALS[lang], n)) for n in (1, 2)]
            for _ in range(3 - len(made)):
                text = f"{rng.choice(OPENINGS)} {rng.choice(CORES)} {rng.choice(CLOSINGS).format(name=name)}".strip().replace("  ", " ") + ". " + rng.choice(AFTER)
                made.append(text[0].upper() + text[1:])
            out += [(q, t.strip().upper() if rng.random() < 0.08 else t.strip(), "refusal") for t in made]
        elif kind == 2:
            words = q.split()
            if len(words) > 3 and rng.random() < 0.3:
                i = rng.randrange(1, len(words) - 1)
                words[i], words[i - 1] = words[i - 1], words[i]
            text = " ".join(words)
            out.append((q, rng.choice([text, text, text.rstrip("?？؟.。;") + ".", text.upper(), f"{text} {text}", f"“{text}", f"Q: {text}", f"**{text}", text.rstrip("?？؟.。;"), f"Question: {text}"]), "copies_question"))
        elif kind == 3:
            choice = [x for x in langs if x != expected_language(q) and x != "latin"]
            if choice and expected_language(q) != "latin":
                out.append((q, rng.choice(by_lang[rng.choice(choice)]), "wrong_language"))
        else:
            out.append((q, rng.choice([*sorted(PLACEHOLDERS), "", " ", "\t \n", "​", "\xa0\xa0"]), "empty"))
    return out


def _arrays(rows: list[tuple[str | None, str | None, bool]]) -> tuple[list[list[int]], np.ndarray]:
    return [hashed(a) for _, a, _ in rows], np.array([pair_features(*r) for r in rows], dtype=float).reshape(-1, DENSE)


def trained(goldens: DataFrame) -> tuple[Classifier, DataFrame]:
    """The classifier, and (id, question, answer, cut) of every id."""
    spark = goldens.sparkSession
    one = goldens.filter("id IS NOT NULL").groupBy("id").agg(F.max("input").alias("input"), F.max("expectedOutput").alias("expectedOutput"), F.max("context").alias("context"))
    one = materialize(one, "pairs")
    usable = one.filter("input IS NOT NULL AND length(trim(expectedOutput)) > 3").orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    sample = [(r[0], r[1], r[2]) for r in usable.select("id", "input", "expectedOutput").collect()]
    made = synthetic([(q, a) for _, q, a in sample])
    extra = [(f"synthetic {k}", a) for k, (_, a, d) in enumerate(made) if d not in ("empty", "")]
    known = one.select("id", "expectedOutput", "context")
    if extra:  # judged beside the corpus, so that made answers get the same evidence
        known = known.unionByName(spark.createDataFrame(extra, "id string, expectedOutput string").withColumn("context", F.lit(None).cast("string")))
    cut = materialize(cutoff.judged(known).filter("field = 'expectedOutput'").select("id", "cut"), "cut")
    pairs = one.join(cut, "id", "left").select("id", "input", "expectedOutput", F.coalesce("cut", F.lit(False)).alias("cut"))
    clf = Classifier()
    if not sample:
        return clf, pairs
    wanted = spark.createDataFrame([(i,) for i, *_ in sample] + [(i,) for i, _ in extra], "id string")
    flag = dict(cut.join(wanted, "id").collect())  # at most as many as the sample's bound and what was made of it
    rows = [(q, a, flag.get(i, False)) for i, q, a in sample] + [(q, a, flag.get(f"synthetic {k}", False)) for k, (q, a, _) in enumerate(made)]
    y = np.zeros((len(rows), len(DEFECTS)))
    for k, (_, _, d) in enumerate(made):
        if d:
            y[len(sample) + k, DEFECTS.index(d)] = 1
    use = np.ones_like(y)
    h, dense = _arrays(rows)
    # pairs of the sample with strong evidence of a defect are no examples of its absence
    for column, defect in ((0, "truncated"), (4, "copies_question"), (7, "wrong_language")):
        use[: len(sample), DEFECTS.index(defect)] = dense[: len(sample), column] < 0.6
    held = np.array([zlib.crc32(str(k).encode()) % 3 == 0 for k in range(len(rows))])
    fold = np.array([zlib.crc32(f"fold {k}".encode()) % FOLDS for k in range(len(rows))])
    pick = lambda m: ([h[i] for i in np.flatnonzero(m)], dense[m], y[m], use[m])
    # Pairs of the sample that have a defect, as units see it that were not fitted on them, are no examples of its absence.
    for _ in range(2):
        p = np.zeros_like(y)
        for f in range(FOLDS):
            clf.fit(*pick(fold != f), FOLD_STEPS)
            p[fold == f] = clf.scores(*pick(fold == f)[:2])
        sound = (p[: len(sample)] < DOUBT).all(axis=1, keepdims=True)
        use[: len(sample)] = np.where(sound, 1, 0)
    clf.fit(*pick(~held))
    clf.calibrate(*pick(held))
    return clf, pairs


def _flag(clf: Classifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                ids, q, a, cut = (part.column(n).to_pylist() for n in ("id", "input", "expectedOutput", "cut"))
                h, dense = _arrays(list(zip(q, a, cut)))
                p = clf.scores(h, dense)
                out: list[tuple[str, str]] = []
                for i, key in enumerate(ids):
                    got = {d for k, d in enumerate(DEFECTS) if p[i, k] >= clf.at[k]}
                    if "empty" in got or not (a[i] or "").strip("​﻿\xa0\u3000 \t\r\n"):
                        got = {"empty"}  # nothing is there to be judged further
                    if got & {"refusal", "copies_question"}:
                        got -= {"wrong_language"}
                    if q[i] is None:
                        got -= {"copies_question", "wrong_language"}
                    out += [(key, d) for d in sorted(got)]
                keys, kinds = zip(*out) if out else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(list(keys), pa.string()), pa.array(list(kinds), pa.string())], ["id", "defect"])

    return run


def found(goldens: DataFrame) -> DataFrame:
    """Distinct (id, defect). An answer that is null, blank or found to be a placeholder is 'empty' and nothing else; where the input is null, only 'empty', 'truncated' and 'refusal' count."""
    clf, pairs = trained(goldens)
    return pairs.mapInArrow(_flag(clf), "id string, defect string").distinct()
