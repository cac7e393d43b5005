"""Operator 9: toxicity of text restored by noisy-channel decoding.

Channel: a writer hides a word by look-alike characters (1 for i or l, @ for a),
by separators between its letters (single spaces, dots, dashes), or by repeating
letters. A disguised token gives a lattice in which each character stands for some
letters, or for none. Viterbi search finds the most likely letters under a character
trigram model and the channel's costs. A run of single characters may hide several
words: each space is dropped or ends a word, and the words of every division whose
cost comes near the cheapest one's are restored. The restored words join the text's own, and
logistic regression over a lexicon learned from labels scores them; a word that
almost only labelled documents have decides by itself.

The language model's counts come from all characters of all documents: every task
counts trigrams over its texts and sends its non-zero counts. The lexicon and its
weights come from a bounded sample of about TRAIN_ROWS labelled rows of the
training fold, one document an id, read through the same decoding; words that stand
in fewer than three of its labelled documents aren't looked at. The MOST_WORDS most
surprising ones have weights, the MOST_TELLING most telling ones decide alone.

Cases: null texts are empty and score as a text without any lexicon word. Without
labels of both kinds (empty tables) every score is the share of label 1 (0.5 without
labels). Repeated rows give repeated results; very long texts and tokens are whole,
in time and memory in proportion. A number in its usual form is a number: '455' is
never read as letters, '4$5' is. Extra columns are kept whatever their names; those
named as a result, in any case, are replaced by it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import col, crc_mod, map_texts, materialize, prepare, slices, table
from quire.llm.rule_ensemble import labelled_sample, lasso

TRAIN_ROWS = 12_000
MOST_WORDS, MOST_TELLING = 400, 4000
THRESHOLD = 0.5
LASSO = 1e-5
#: A word tells by itself if so large a share of its documents is labelled, at the lower end of its confidence interval of Z spreads.
TELLING, Z = 0.8, 2.0

#: Letters of the model; code 0 is the boundary of a word, 1 any other letter.
LETTERS = "abcdefghijklmnopqrstuvwxyzàâäáãåæçèéêëìíîïñòóôöõøœùúûüýÿßğışčćžšđłńśźżőű"
SIZE = len(LETTERS) + 2

#: What a disguised character may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
    "*": "aeiou", "#": "h", "%": "x", "&": "a", "<": "c", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i",
}
SEPARATORS = set(" .-_*'/\\|~^,:;")
#: Costs (negative log probability) of the channel's acts.
SWAP, DROP_SEPARATOR, DROP_SYMBOL = 0.7, 0.3, 4.0
#: (keep, drop) of a letter that repeats the one before: the second of two, the second of more, later ones.
REPEATS = ((0.0, 1.2), (0.7, 0.3), (3.0, 0.1))
#: In runs of single characters: a space that ends a word, a lone symbol that is only punctuation.
END_WORD, DROP_LONE = 1.35, 2.0
#: Divisions of a run count if they cost so much more than the cheapest at most; words in longer runs have LONGEST letters at most, or are the whole run.
NEAR, LONGEST = 12.0, 32

_WORD_MAP = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: Punctuation around a word; one or two symbols at an end may be letters, a longer run of a symbol is not.
_AROUND = ".,;:!?\"'()[]{}<>|*&%#=-_/\\"
_TAIL = re.compile(r"([^\w\s])\1+\Z")
_PLAIN = re.compile(r"[^\W\d_]+\Z")
_DOUBLE = re.compile(r"([^\W\d_])\1")
_LETTER = re.compile(r"[^\W\d_]")
_LATIN = re.compile("[a-zß-ɏ]")
_NUMBER = re.compile(r"[+\-(#]?[$€£]?\d[\d.,:;/'\-+]*[%€$£]?\)?\Z")
#: Letters of other scripts that look like one of ours.
_OTHER = {ord(ch): x for ch, x in LOOKALIKES.items() if ch.isalpha()}
_OTHERS = re.compile("[" + "".join(map(chr, _OTHER)) + "]")
#: Tokens that may hide a word: all but single letters of one script in turn, none doubled, between marks that stand for no letter.
_MARKS = re.escape("".join(ch for ch in _AROUND if ch not in LOOKALIKES))
_SUSPECT = re.compile(rf"(?<!\S)(?![{_MARKS}]*+(?:([^\W\d_{''.join(map(chr, _OTHER))}])(?!\1))*+[{_MARKS}]*+(?!\S))\S+")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")


def letter_codes() -> np.ndarray:
    """Code of each character below 0x250: boundary unless a letter."""
    codes = np.zeros(0x250, np.uint8)
    for i in range(0x250):
        if chr(i).isalpha():
            codes[i] = 1
    for k, ch in enumerate(LETTERS):
        codes[ord(ch)] = k + 2
    return codes


def count_trigrams(texts: Sequence[str | None], codes: np.ndarray, total: np.ndarray) -> None:
    """Adds the texts' character trigrams to ``total`` (SIZE cubed)."""
    joined = "\n\n".join(t.lower() for t in texts if t)
    if not joined:
        return
    raw = np.frombuffer(f"\n\n{joined}\n\n".encode("utf-32-le", "surrogatepass"), "<u4")
    c = np.where(raw < len(codes), codes[np.minimum(raw, len(codes) - 1)], 1).astype(np.int32)
    gram = (c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:]
    total += np.bincount(gram, minlength=SIZE**3)


def trigrams(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (gram, n): counts over all texts, pre-aggregated in each task."""
    prepare(df.sparkSession)

    def run(batches):
        codes, total = letter_codes(), np.zeros(SIZE**3, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for start, stop in slices(texts):
                count_trigrams(texts[start:stop], codes, total)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(total[some])], names=["gram", "n"])

    return df.select(col(text_col).cast("string").alias("text")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class Model:
    """Interpolated character trigram model: cost of c after a, b."""

    def __init__(self, counts: np.ndarray) -> None:
        tri = counts.reshape(SIZE, SIZE, SIZE).astype(np.float64)
        bi, uni = tri.sum(0), tri.sum((0, 1))
        p1 = (uni + 1) / (uni.sum() + SIZE)
        p2 = (bi + 20 * p1) / (bi.sum(1, keepdims=True) + 20)
        p3 = (tri + 5 * p2) / (tri.sum(2, keepdims=True) + 5)
        self.cost = (-np.log(p3)).astype(np.float32)
        # A word's first letters don't depend on the word before.
        self.cost[:, 0, :] = -np.log(p2[0])


#: The cheapest path to each state (last two letters): its cost, its latest letters, and those before as (before, letters).
Paths = dict[tuple[int, int], tuple[float, str, tuple | None]]
FOLD = 64


def spelled(text: str, before: tuple | None) -> str:
    """A path's letters; paths share what stands before, so that long tokens take time and memory in proportion."""
    out = [text]
    while before is not None:
        before, text = before
        out.append(text)
    return "".join(reversed(out))


class Decoder:
    """Restores disguised tokens; remembers them up to ``most`` and ``most_chars`` of them."""

    def __init__(self, model: Model, most: int = 200_000, most_chars: int = 4_000_000) -> None:
        self.cost, self.most, self.most_chars, self.chars = model.cost.tolist(), most, most_chars, 0
        self.code = {ch: k + 2 for k, ch in enumerate(LETTERS)}
        self.known: dict[str, tuple[str, ...]] = {}

    def options(self, token: str, i: int) -> list[tuple[str, float]]:
        ch = token[i]
        out: list[tuple[str, float]] = []
        if ch.isalpha():
            if i > 0 and token[i - 1] == ch:
                later = i > 1 and token[i - 2] == ch
                keep, drop = REPEATS[2 if later else int(token[i + 1 : i + 2] == ch)]
                out += [(ch, keep), ("", drop)]
            else:
                out.append((ch, 0.0))
        out += [(x, SWAP) for x in LOOKALIKES.get(ch, "")]
        if ch in SEPARATORS or not out:
            out.append(("", DROP_SEPARATOR if ch in SEPARATORS else DROP_SYMBOL))
        return out

    def viterbi(self, token: str, left: int = 0, right: int = 0) -> str:
        """The cheapest letters of the token's lattice, in which the first ``left`` and last ``right`` characters stand for letters."""
        best: Paths = {(0, 0): (0.0, "", None)}
        for i in range(len(token)):
            options = self.options(token, i)
            if i < left or i >= len(token) - right:
                options = [o for o in options if o[0]]
            best = self.step(best, options)
            if i % FOLD == FOLD - 1:
                best = {state: (cost, "", (before, text)) for state, (cost, text, before) in best.items()}
        return spelled(*self.ended(best)[1:])

    def undoubled(self, token: str) -> str:
        """``viterbi`` of a token of letters: where only some are doubled, its lattice has few paths, which are gone through one by one."""
        places = [m.start() + 1 for m in _DOUBLE.finditer(token)]
        if len(places) > 3 or _TRIPLE.search(token):
            return self.viterbi(token)
        codes = [self.code.get(ch, 1) for ch in token]
        best, dropped = math.inf, ()
        for some in range(1 << len(places)):
            gone = tuple(x for k, x in enumerate(places) if some >> k & 1)
            a = b = 0
            total = 0.0
            for i, c in enumerate(codes):
                if i in gone:
                    total += REPEATS[0][1]
                else:
                    total, a, b = total + self.cost[a][b][c], b, c
            total += self.cost[a][b][0]
            if total < best:
                best, dropped = total, gone
        return "".join(ch for i, ch in enumerate(token) if i not in dropped)

    def step(self, best: Paths, options: list[tuple[str, float]]) -> Paths:
        new: Paths = {}
        for (a, b), (cost, text, before) in best.items():
            for letter, paid in options:
                if letter:
                    c = self.code.get(letter, 1)
                    state, total = (b, c), cost + paid + self.cost[a][b][c]
                else:
                    state, total = (a, b), cost + paid
                if state not in new or total < new[state][0]:
                    new[state] = (total, text + letter, before)
        return new

    def ended(self, best: Paths) -> tuple[float, str, tuple | None]:
        return min(((cost + self.cost[a][b][0], text, before) for (a, b), (cost, text, before) in best.items()), key=itemgetter(0))

    def divided(self, run: list[str]) -> set[str]:
        """The words of all near-cheapest divisions of single characters, and the whole run as one word.

        A word's cost doesn't depend on the word before, so costs up to and from each
        place tell the cheapest division that any word is part of.
        """
        n, spaced = len(run), " ".join(run)
        options = [self.options(spaced, 2 * k) + [("", DROP_LONE)] * (run[k] in _AROUND and run[k] in LOOKALIKES) for k in range(n)]
        words = []
        upto = [0.0] + [math.inf] * n
        for i in range(n):
            best: Paths = {(0, 0): (0.0, "", None)}
            for j in range(i, min(n, i + LONGEST)):
                best = self.step(best, options[j] if j == i else [(x, paid + DROP_SEPARATOR) for x, paid in options[j]])
                cost, text, _ = self.ended(best)
                cost += END_WORD if i else 0.0
                words.append((i, j + 1, cost, text))
                upto[j + 1] = min(upto[j + 1], upto[i] + cost)
        after = [math.inf] * n + [0.0]
        for i, j, cost, _ in reversed(words):
            after[i] = min(after[i], cost + after[j])
        found = {text for i, j, cost, text in words if upto[i] + cost + after[j] <= upto[n] + NEAR}
        found.add(self.viterbi(spaced))
        return found - {""}

    def cores(self, token: str) -> list[tuple[str, int, int]]:
        """The token without what stands around it, and with up to two symbols at each end that may be letters, and how many."""
        core = _TAIL.sub("", token).strip(_AROUND)
        if not core or _NUMBER.match(core) or core == token:
            return [(core, 0, 0)]
        start = len(token) - len(token.lstrip(_AROUND))
        end = start + len(core)
        left, right = [start], [end]
        for k in (start - 1, start - 2):
            if k < 0 or token[k] not in LOOKALIKES or token[max(0, k - 2) : k + 1] == token[k] * 3:
                break
            left.append(k)
        for k in (end, end + 1):
            if k >= len(token) or token[k] not in LOOKALIKES or token[k : k + 3] == token[k] * 3:
                break
            right.append(k + 1)
        return [(token[i:j], start - i, j - end) for i in left for j in right]

    def token(self, token: str) -> tuple[str, ...]:
        """The words that a lower-case token may hide; none if it is an ordinary word or number."""
        if token in self.known:
            return self.known[token]
        if len(self.known) >= self.most or self.chars > self.most_chars:
            self.known.clear()
            self.chars = 0
        self.chars += len(token)
        found = []
        for core, left, right in self.cores(token):
            plain = core
            if _OTHERS.search(core) and (_LATIN.search(core) or all(ord(ch) in _OTHER for ch in _LETTER.findall(core))):
                plain = core.translate(_OTHER)
            if _PLAIN.match(plain) and not _DOUBLE.search(plain):
                found += [plain] * (plain != core)
            elif _PLAIN.match(plain) and left == right == 0:
                found.append(self.undoubled(plain))
            elif not _NUMBER.match(plain) and (_LETTER.search(plain) or len(set(plain)) > 1 and all(ch in LOOKALIKES for ch in plain)):
                found.append(self.viterbi(plain, left, right))
        out = self.known[token] = tuple(w for w in found if w)
        return out

    def restored(self, low: str) -> list[str]:
        """Words that stand behind disguised tokens of a lower-case text and behind its runs of single characters."""
        found = [w for ws in map(self.token, {m[0] for m in _SUSPECT.finditer(low)}) for w in ws]
        words = low.split()
        cores = [w.strip(_AROUND) or w for w in words]
        singles = bytes(map((1).__eq__, map(len, cores)))
        at = singles.find(b"\1\1\1")
        while at >= 0:
            end = singles.find(b"\0", at)
            end = len(words) if end < 0 else end
            run = cores[at:end]
            if len(set(run)) > 1:
                found += self.divided(run)
            at = singles.find(b"\1\1\1", end)
        return found


def words_of(text: str | None, decoder: Decoder) -> set[str]:
    """The text's words (letters only) and its restored words."""
    if not text:
        return set()
    low = text.lower()
    plain = low.encode("utf-8", "surrogatepass").translate(_WORD_MAP).decode("utf-8", "replace")
    return set(plain.split()).union(decoder.restored(low))


class Lexicon:
    """Logistic weights of words, and the telling words with their least shares."""

    def __init__(self, intercept: float, weights: dict[str, float], telling: dict[str, float] | None = None) -> None:
        self.intercept, self.weights, self.telling = intercept, weights, telling or {}

    def score(self, words: set[str]) -> float:
        """The logistic score, or the most telling word's share if that is larger: a single word is enough."""
        total = self.intercept + sum(self.weights[w] for w in sorted(self.weights.keys() & words))
        alone = max((self.telling[w] for w in self.telling.keys() & words), default=0.0)
        return max(alone, 1 / (1 + math.exp(-max(-30.0, min(30.0, total)))))

    def matched(self, words: set[str]) -> list[str]:
        return sorted((self.weights.keys() | self.telling.keys()) & words)


def weigh(samples: list[tuple[set[str], int]], chosen: list[str], telling: dict[str, float], penalty: float = LASSO) -> Lexicon:
    """Lasso logistic weights of the chosen words."""
    n = len(samples)
    ones = sum(y for _, y in samples)
    if n == 0 or ones in (0, n):
        mean = ones / n if n else 0.5
        return Lexicon(math.log(max(mean, 1e-6) / max(1 - mean, 1e-6)), {})
    z = np.array([[w in words for w in chosen] for words, _ in samples], np.float64).reshape(n, len(chosen))
    intercept, weights = lasso(z, np.array([y for _, y in samples], np.float64), penalty, 1500)
    return Lexicon(intercept, {w: float(x) for w, x in zip(chosen, weights, strict=True) if abs(x) > 1e-9}, telling)


def choose(words: DataFrame, n: int, ones: int, most: int = MOST_WORDS, most_telling: int = MOST_TELLING) -> tuple[list[str], dict[str, float]]:
    """From rows (y, words), one a document: the words that stand in label 1 far more often than by chance, and the telling ones."""
    rate, k, m = ones / n, F.col("k"), F.col("m")
    counts = words.select("y", F.explode("words").alias("w")).groupBy("w").agg(F.sum("y").alias("k"), F.count("*").alias("m")).filter("k >= 3")
    counts = counts.withColumn("surprise", (k - m * rate) / F.sqrt(m * (rate * (1 - rate))))
    p = k / m
    share = (p + Z * Z / (2 * m) - Z * F.sqrt(p * (1 - p) / m + Z * Z / (4 * m * m))) / (1 + Z * Z / m)  # the lower end of Wilson's interval
    counts = materialize(counts.withColumn("share", share), "counts")
    chosen = counts.filter((k > 2.5 * rate * m) & (F.col("surprise") >= 4.0)).orderBy(F.desc("surprise"), "w").limit(most).collect()
    telling = counts.filter(F.col("share") >= TELLING).orderBy(F.desc("share"), F.desc("k"), "w").limit(most_telling).collect()
    return sorted(r["w"] for r in chosen), {r["w"]: r["share"] for r in telling}


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> tuple[Model, Lexicon]:
    """The language model from all ``documents``, the lexicon from a bounded sample of ``labels``."""
    spark = documents.sparkSession
    counts = np.zeros(SIZE**3, np.int64)
    for r in trigrams(documents, text_col).collect():  # SIZE cubed rows at most
        counts[r["gram"]] = r["n"]
    model = Model(counts)
    sent = spark.sparkContext.broadcast(model)

    def factory():
        decoder = Decoder(sent.value)
        return lambda texts: [[sorted(words_of(t, decoder)) for t in texts]]

    sample = labelled_sample(documents, labels, label, id_col, text_col, rows)
    fields = T.StructType([T.StructField("words", T.ArrayType(T.StringType()))])
    words = materialize(map_texts(sample, "text", fields, factory, keep=["id", "y"]), "words")  # decoded once
    n, ones = words.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    chosen, telling = choose(words, n, ones) if 0 < ones < n else ([], {})
    # Only the documents' chosen words go to the driver.
    wanted = F.broadcast(spark.createDataFrame([(w,) for w in chosen], "w string"))
    has = words.select("id", F.explode("words").alias("w")).join(wanted, "w").groupBy("id").agg(F.collect_list("w").alias("w"))
    got = words.select("id", "y").join(has, "id", "left").collect()  # 2 * `rows` documents at most
    got.sort(key=lambda r: (r["id"], r["y"]))
    return model, weigh([(set(r["w"] or ()), r["y"]) for r in got], chosen, telling)


def score(df: DataFrame, model: Model, lexicon: Lexicon, text_col: str = "text", keep: Sequence[str] | None = None, prefix: str = "", threshold: float = THRESHOLD) -> DataFrame:
    """Adds score (0 to 1), predicted (score >= threshold) and matched, the lexicon words found."""
    sent = df.sparkSession.sparkContext.broadcast((model, lexicon))

    def factory():
        decoder, words = Decoder(sent.value[0]), sent.value[1]

        def work(texts):
            found = [words_of(t, decoder) for t in texts]
            scores = [words.score(f) for f in found]
            return scores, [int(s >= threshold) for s in scores], [words.matched(f) for f in found]

        return work

    fields = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("matched", T.ArrayType(T.StringType()))])
    return map_texts(df, text_col, fields, factory, keep, prefix)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model, lexicon = train(documents, labels.filter(crc_mod("doc_id", 5) != 0))
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return score(documents, model, lexicon, keep=["doc_id"]).select("doc_id", held.alias("held_out"), "score", "predicted", "matched")


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLES: dict[str, str] = {}
