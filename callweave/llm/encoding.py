"""Text that was decoded with the wrong character set: find it, and restore it where that can be done.

A smoothed character trigram model is trained on the clean records of the corpus itself. For every
token with characters beyond ASCII, each chain (encode with the set that was wrongly taken, decode
with the right one) gives a candidate; the gain in log likelihood, summed over the tokens of a text,
decides between the chains, and the likeliest is taken if its gain passes a margin. The margins, one for
chains to UTF-8 and one for single-byte chains, are set from what all clean records reach by chance; one
word that clean records know well, in the place of one they don't, proves a chain too.
"""

from __future__ import annotations

import collections
import dataclasses
import functools
import itertools
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.text import spread
from callweave.runtime import cut

# Character sets that text is wrongly read with; it was written in another of them or in UTF-8.
WRONG = ("cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "cp437", "cp850", "mac-roman")

#: A chain is proven by one word that so many clean texts know, if they know it so many times as often as
#: the word in its place; by a single-byte chain the word must have so many characters.
PROOF_CHARS, PROOF_TEXTS, PROOF_TIMES = 3, 3, 20
#: No character costs more than this, so that rare but intended ones don't outweigh all else; one that no
#: clean text holds costs as much again where a chain would bring it in.
WORST = -9.0
#: Width of the bins that chance gains of clean texts are counted in.
BIN = 0.125
#: Kept are n-grams with at least this share of all characters of clean texts, and words with at least this
#: share of all their words beyond ASCII: so at most 2,000,000 of each kind, whatever the corpus. Rarer ones
#: can't decide between chains; while the corpus has fewer than 2,000,000 nothing is left out.
LEAST_SHARE = 5e-7

LOST = "�"
_C1 = regex.compile("[\x80-\x84\x86-\x9f]")
_MULTIBYTE = regex.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_TOKENS = regex.compile(r"[^ \n\t\r]+")
#: Signs inside words, a capital after a small letter, or letters with accents only: what reading
#: one single-byte set as another leaves. Texts with such words are kept out of the model.
_ODD = regex.compile(r"\p{L}[\p{S}\p{No}¿¡]\p{L}|[\p{Ll}&&\P{ASCII}]\p{Lu}|\p{Ll}[\p{Lu}&&\P{ASCII}]|[À-ÖØ-öø-ÿ]{4}", regex.V1)
_CAPITALS = regex.compile(r"(?<!\p{L})[А-ЯЁ]{2,}(?!\p{L})")


def _encode_char(ch: str, charset: str) -> bytes | None:
    try:
        b = ch.encode(charset)
    except UnicodeEncodeError:
        # bytes a set leaves undefined are often let through as they are
        return bytes([ord(ch)]) if charset != "latin-1" and 0x80 <= ord(ch) <= 0x9F else None
    return b if len(b) == 1 else None


_BYTES = {w: {ch: b for ch in map(chr, _SEEN) if (b := _encode_char(ch, w))} for w, _SEEN in ((w, sorted({*range(0x80, 0xA0), *(ord(c) for c in bytes(range(256)).decode(w, "ignore"))})) for w in WRONG)}
_TWO = regex.compile("[^\x00-\x7f]{2}")


def undo_utf8(token: str, wrong: str) -> str | None:
    """The token with its runs that are UTF-8 read as another set put right; null if there are none."""
    if not _TWO.search(token):
        return None  # a sequence has at least two bytes beyond ASCII
    known = _BYTES[wrong]
    raw = b"".join([known.get(ch, b"\x00") for ch in token])  # what the set doesn't hold breaks any sequence
    out, last = [], 0
    for m in _MULTIBYTE.finditer(raw):
        try:
            fixed = m.group().decode("utf-8")
        except UnicodeDecodeError:
            continue
        out.append(token[last : m.start()])
        out.append(fixed)
        last = m.end()
    return "".join([*out, token[last:]]) if last else None


def undo_legacy(token: str, wrong: str, right: str) -> str | None:
    """The token encoded with one single-byte set and decoded with another; null if impossible."""
    try:
        fixed = token.encode(wrong).decode(right)
    except UnicodeError:
        return None
    return fixed if fixed != token else None


def undo_all_legacy(token: str) -> Iterator[tuple[tuple[str, str], str]]:
    """(chain, fixed) of all single-byte chains that change the token; each set encodes it once."""
    for w in WRONG:
        try:
            raw = token.encode(w)
        except UnicodeError:
            continue
        for r in WRONG:
            if r != w:
                try:
                    fixed = raw.decode(r)
                except UnicodeError:
                    continue
                if fixed != token:
                    yield (w, r), fixed


def chains() -> list[tuple[str, str]]:
    return [(w, "utf-8") for w in WRONG] + [(w, r) for r in WRONG for w in WRONG if w != r]


def apply_chain(token: str, chain: tuple[str, str]) -> str | None:
    return undo_utf8(token, chain[0]) if chain[1] == "utf-8" else undo_legacy(token, *chain)


def tokens_of(text: str) -> list[str]:
    """What stands between blanks and line ends."""
    return [t for t in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if t]


def structurally_clean(text: str) -> bool:
    """No lost or control characters, no odd words, and for no set are most of the tokens beyond ASCII, as wholes,
    UTF-8 read as that set. (A few words of other scripts decode by chance.)"""
    if text.isascii():
        return True
    if LOST in text or _C1.search(text) or len(_CAPITALS.findall(text)) >= 3:
        return False
    decoded, n = [0] * len(WRONG), 0
    for t in tokens_of(text):
        if not t.isascii():
            n += 1
            odd, sets = _signs(t) if len(t) <= 200 else _signs.__wrapped__(t)
            if odd:
                return False
            for i in sets:
                decoded[i] += 1
    return max(decoded) * 2 <= n


@functools.lru_cache(maxsize=200_000)
def _signs(token: str) -> tuple[bool, tuple[int, ...]]:
    """Whether a token is odd, and places in WRONG of the sets as which the whole token could be UTF-8 read wrongly."""
    out = []
    for i, w in enumerate(WRONG if _TWO.search(token) else ()):
        try:
            token.encode(w).decode("utf-8")
            out.append(i)
        except UnicodeError:
            pass
    return _ODD.search(token) is not None, tuple(out)


_FOLDED = bytes.maketrans(b"\t\n\r123456789" + bytes(range(65, 91)), b"   000000000" + bytes(range(97, 123)))


def fold(text: str) -> str:
    """Letters A-Z in lower case, digits as 0, line ends as blanks; all else as it is."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLDED).decode("utf-8", "surrogatepass")


def _grams(points: np.ndarray, n: int) -> np.ndarray:
    """All n-grams of code points, each packed into one number."""
    size = max(len(points) - n + 1, 0)
    out = np.zeros(size, np.uint64)
    for j in range(n):
        out = (out << np.uint64(21)) | points[j : j + size]
    return out.astype(np.int64)


class CharModel:
    """Interpolated character trigrams: counts by length of the n-gram and packed n-gram."""

    def __init__(self, counts: dict[int, dict[int, int]], smoothing: float = 5.0):
        self.counts, self.k = counts, smoothing
        self.total = float(sum(counts[1].values())) + 1.0
        self.cache: dict[str, float] = {}

    def _log(self, gram: str) -> float:
        got = self.cache.get(gram)
        if got is None:
            a, b, c = map(ord, gram)
            one, two, three = self.counts[1], self.counts[2], self.counts[3]
            ab, bc = a << 21 | b, b << 21 | c
            p1 = (one.get(c, 0) + 0.5) / (self.total + 500)
            p2 = (two.get(bc, 0) + self.k * p1) / (one.get(b, 0) + self.k)
            got = max(WORST, math.log((three.get(a << 42 | bc, 0) + self.k * p2) / (two.get(ab, 0) + self.k)))
            if len(self.cache) > 1_000_000:
                self.cache.clear()
            self.cache[gram] = got
        return got

    def score(self, token: str) -> float:
        """Log likelihood of a token between blanks."""
        t = f"  {fold(token)} "
        return sum(self._log(t[i : i + 3]) for i in range(len(t) - 2))

    def unseen(self, token: str) -> int:
        """How many of its characters no clean text holds."""
        return sum(not ch.isascii() and ord(ch) not in self.counts[1] for ch in token)


def count_clean(texts: DataFrame) -> DataFrame:
    """(kind, word, hits) over all clean texts, in one pass: token, how often each folded token occurs;
    word, how many texts hold a word beyond ASCII or the shape of one; text, how many there are, all of
    them under the empty word and those beyond ASCII under a."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            tokens, known, n, beyond = collections.Counter(), collections.Counter(), 0, 0
            for t in b["text"]:
                if not structurally_clean(t):
                    continue
                n += 1
                parts = fold(t).split(" ")
                tokens.update(parts)
                if not t.isascii():
                    beyond += 1
                    cores = {c for k in parts if not k.isascii() and len(c := k.strip(_SIGNS)) <= 200}
                    known.update(cores | {_shape(c) for c in cores})
            tokens.pop("", None)
            rows = [("token", w, h) for w, h in tokens.items()] + [("word", w, h) for w, h in known.items()] + [("text", "", n), ("text", "a", beyond)]
            yield pd.DataFrame(rows, columns=["kind", "word", "hits"])

    return cut(texts.mapInPandas(count, "kind string, word string, hits bigint").groupBy("kind", "word").agg(F.sum("hits").alias("hits")))


def train(counted: DataFrame, least_share: float = LEAST_SHARE) -> CharModel:
    """The model of all clean records from the result of count_clean. What is collected is bounded by
    least_share, not by the corpus."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            points = np.frombuffer("".join(f"  {w} " for w in b["word"]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            lengths = np.array([len(w) + 3 for w in b["word"]])
            own = np.repeat(np.arange(len(b)), lengths)
            weights = b["hits"].to_numpy()[own]
            for n in (1, 2, 3):
                whole = own[: len(own) - n + 1] == own[n - 1 :]
                grams, at = np.unique(_grams(points, n)[whole], return_inverse=True)
                hits = np.bincount(at, weights=weights[: len(whole)][whole]).astype(np.int64)
                yield pd.DataFrame({"n": np.int32(n), "gram": grams, "hits": hits})

    words = counted.where("kind = 'token'").select("word", "hits")
    every = cut(words.mapInPandas(count, "n int, gram bigint, hits bigint").groupBy("n", "gram").agg(F.sum("hits").alias("hits")))
    total = every.where("n = 1").agg(F.coalesce(F.sum("hits"), F.lit(0))).first()[0]
    rows = every.where(F.col("hits") >= least_share * total).toPandas()
    counts: dict[int, dict[int, int]] = {1: {}, 2: {}, 3: {}}
    for n, part in rows.groupby("n"):
        counts[int(n)] = dict(zip(part["gram"].tolist(), part["hits"].tolist(), strict=True))
    return CharModel(counts)


_LETTERS = regex.compile("[a-z]+")
_SIGNS = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum())


def _core(token: str) -> str:
    """The token folded as for the model, without ASCII signs around."""
    return fold(token).strip(_SIGNS)


def _shape(core: str) -> str:
    """The word with each run of ASCII letters as one; marked, so that it equals no word."""
    return "\n" + _LETTERS.sub("a", core)


def known_words(counted: DataFrame, least_share: float = LEAST_SHARE) -> tuple[dict[str, int], int]:
    """Words beyond ASCII, and shapes of such words, that two or more of the clean texts hold, with the
    number of these texts; and how many texts a word may be in without being among them."""
    words = counted.where("kind = 'word'")
    total = words.agg(F.coalesce(F.sum("hits"), F.lit(0))).first()[0]
    least = max(2, math.ceil(least_share * total))
    found = words.where(F.col("hits") >= least).select("word", "hits").toPandas()
    return dict(found.itertuples(index=False, name=None)), least - 1 if least > 2 else 0


@dataclasses.dataclass(frozen=True)
class Margins:
    """Gains above these are accepted without proof: of single-byte chains, and of chains to UTF-8."""

    single: float = math.inf
    utf8: float = math.inf


class Judge:
    """Finds the likeliest chain for texts under a model and the words of clean texts."""

    def __init__(self, model: CharModel, words: dict[str, int], margins: Margins = Margins(), unlisted: int = 0):
        self.model, self.words, self.margins, self.unlisted = model, words, margins, unlisted
        self.gains: dict[str, list[tuple[tuple[str, str], str, float, bool]]] = {}

    def token(self, token: str) -> list[tuple[tuple[str, str], str, float, bool]]:
        """(chain, fixed, gain, proven) of all chains that change the token, if the gain is above 0
        or the chain proven. No chain makes a word into a rarer one, or into an unknown one of a rarer
        shape."""
        got = self.gains.get(token)
        if got is None:
            base, got, seen = None, [], {}
            own, shaped = (self.words.get(x, 0) for x in (_core(token), _shape(_core(token))))
            utf8 = (((w, "utf-8"), f) for w in WRONG if (f := undo_utf8(token, w)))
            for chain, fixed in itertools.chain(utf8, undo_all_legacy(token)):
                if LOST in fixed or (chain[1] != "utf-8" and _C1.search(fixed)):
                    continue
                if fixed not in seen:
                    core = _core(fixed)
                    hits = self.words.get(core, 0)
                    if hits < own or (not hits and self.words.get(_shape(core), 0) < shaped):
                        seen[fixed] = None
                    else:
                        base = self.model.score(token) if base is None else base
                        new = max(self.model.unseen(fixed) - self.model.unseen(token), 0)
                        gain = self.model.score(fixed) - base + WORST * new
                        seen[fixed] = gain, hits >= max(PROOF_TEXTS, PROOF_TIMES * max(own, self.unlisted)), len(core)
                if seen[fixed] is None:
                    continue
                gain, known, n = seen[fixed]
                proven = known and (chain[1] == "utf-8" or n >= PROOF_CHARS)
                if gain > 0 or proven:
                    got.append((chain, fixed, gain, proven))
            if len(self.gains) > 200_000:
                self.gains.clear()
            if len(token) <= 200:
                self.gains[token] = got
        return got

    def weigh(self, text: str) -> tuple[list, list]:
        """[gain, proofs, longest word, chain] of the best chain to UTF-8 and of the best single-byte one: the
        one with most proofs, then the highest gain."""
        sums: dict[tuple[str, str], list] = {}
        for t in tokens_of(text):
            if not t.isascii():
                for chain, _, gain, proven in self.token(t):
                    s = sums.setdefault(chain, [0.0, 0, 0])
                    s[0] += gain
                    s[1] += proven
                    s[2] = max(s[2], len(_core(t)))
        none = [0.0, 0, 0, None]
        utf8 = max(([*s, c] for c, s in sums.items() if c[1] == "utf-8"), key=lambda s: (s[0], s[3]), default=none)
        single = max(([*s, c] for c, s in sums.items() if c[1] != "utf-8"), key=lambda s: (s[1], s[0], s[3]), default=none)
        return utf8, single

    def best(self, text: str) -> tuple[tuple[str, str] | None, float, bool]:
        """(chain, gain, proven): the chain is null if neither proven nor above its margin. A single-byte
        chain without proof needs a word of PROOF_CHARS characters; letters alone decode to anything."""
        utf8, single = self.weigh(text)
        passed = []
        if utf8[3] and (utf8[1] or utf8[0] > self.margins.utf8):
            passed.append((utf8[1] > 0, utf8[0], utf8[3], utf8[1] > 0))
        if single[3] and (single[1] or (single[0] > self.margins.single and single[2] >= PROOF_CHARS)):
            passed.append((single[1] > 0, single[0], single[3], single[1] > 0))
        if not passed:
            return None, 0.0, False
        _, gain, chain, proven = max(passed)
        return chain, gain, proven

    def _fix(self, text: str, chain: tuple[str, str], gain: float) -> str:
        """All tokens the chain improves; of a single-byte chain also those it can decode, if most
        of the text's tokens beyond ASCII gain by it. Below the margin the proven tokens only."""
        tokens = [t for t in tokens_of(text) if not t.isascii()]
        whole = chain[1] == "utf-8" or gain > self.margins.single
        better = {t: f for t in tokens for c, f, _, proven in self.token(t) if c == chain and (whole or proven)}
        if chain[1] != "utf-8" and sum(t in better for t in tokens) * 2 > len(tokens):
            better = {t: apply_chain(t, chain) or t for t in tokens} | better
        return _TOKENS.sub(lambda m: better.get(m.group(), m.group()), text)

    def restore(self, text: str) -> tuple[str, str, float]:
        """(text, chains taken, gain). Text read wrongly several times takes as many rounds; they end when no
        chain is accepted, or one leads back to a text there was before. After a chain to UTF-8 a
        single-byte one must be proven."""
        taken, total, were = [], 0.0, {text}
        while True:
            chain, gain, proven = self.best(text)
            if chain is None or (chain[1] != "utf-8" and not proven and any(c.endswith(">utf-8") for c in taken)):
                break
            fixed = self._fix(text, chain, gain)
            if fixed in were:
                break
            were.add(fixed)
            text, total = fixed, total + gain
            taken.append(f"{chain[0]}>{chain[1]}")
        return text, " ".join(taken), total


_JUDGES: dict[str, Judge] = {}


def _judge(run: str, trained, margins: Margins = Margins()) -> Judge:
    """The judge of a run, kept by the Python worker from task to task with what it knows of tokens."""
    if run not in _JUDGES:
        _JUDGES.clear()
        counts, words, unlisted = trained.value
        _JUDGES[run] = Judge(CharModel(counts), words, unlisted=unlisted)
    judge = _JUDGES[run]
    judge.margins = margins
    return judge


def _doubtful(texts: DataFrame, trained, run: str) -> DataFrame:
    """(key, text, clean, proven, utf8, single) of the texts that any chain improves, or that hold lost characters."""

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = _judge(run, trained)
        for b in batches:
            out = []
            for k, t in zip(b["key"].tolist(), b["text"].tolist(), strict=True):
                utf8, single = judge.weigh(t)
                if utf8[3] or single[3] or LOST in t or _C1.search(t):
                    out.append((k, t, structurally_clean(t), utf8[1] + single[1] > 0, utf8[0], single[0]))
            if out:
                yield pd.DataFrame(out, columns=["key", "text", "clean", "proven", "utf8", "single"])

    return cut(texts.mapInPandas(weigh, "key string, text string, clean boolean, proven boolean, utf8 double, single double"))


def _margins(doubtful: DataFrame, n_clean: int) -> Margins:
    """Margins from the chance gains of all distinct clean texts beyond ASCII. Texts in which a chain is
    proven aren't clean; those that no chain improves gain nothing."""
    clean = doubtful.where("clean").groupBy("text").agg(*[F.first(c).alias(c) for c in ("proven", "utf8", "single")])
    bins = clean.select("proven", *[F.ceil(F.col(c) / BIN).alias(c) for c in ("utf8", "single")]).groupBy("proven", "utf8", "single").agg(F.count(F.lit(1)).alias("n")).collect()
    left = n_clean - sum(r["n"] for r in bins)
    chance = {c: collections.Counter({0: max(left, 0)}) for c in ("utf8", "single")}
    for r in bins:
        if not r["proven"]:
            for c, seen in chance.items():
                seen[r[c]] += r["n"]
    return Margins(validated_margin(list(chance["single"].items())), validated_margin(list(chance["utf8"].items())))


def validated_margin(bins: list[tuple[int, int]]) -> float:
    """A margin: a quarter above what all but one of 2,000 clean records reach by chance.
    Without clean records nothing passes."""
    total, seen = sum(n for _, n in bins), 0
    for b, n in sorted(bins):
        seen += n
        if seen >= 0.9995 * total:
            return 1.25 * BIN * b
    return math.inf


def find_garbled(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chain, gain, restored, complete): a row for each garbled text.

    Garbled is a text that a chain improves beyond its margin or by a proven word, or that holds U+FFFD or
    a C1 control other than NEL. restored is the text after all accepted chains; complete tells that no
    such character is left in it. chain is empty where none was accepted. Null and empty texts are not
    garbled; repeated rows come repeatedly, null keys stay; an empty table gives no rows.
    """
    texts = spread(rows.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where(F.length("text") > 0))
    ascii_only = F.col("text").rlike(r"^[\x00-\x7f]*$")
    beyond = texts.where(~ascii_only)
    counted = count_clean(texts.where(ascii_only).select("text").unionByName(beyond.select("text").distinct()))  # copies count once
    model = train(counted)
    words, unlisted = known_words(counted)
    n_clean = counted.where("kind = 'text' and word = 'a'").agg(F.coalesce(F.sum("hits"), F.lit(0))).first()[0]
    trained = rows.sparkSession.sparkContext.broadcast((model.counts, words, unlisted))
    run = uuid.uuid4().hex
    doubtful = _doubtful(beyond, trained, run)
    margins = _margins(doubtful, n_clean)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = _judge(run, trained, margins)
        for b in batches:
            out = []
            for k, t in zip(b["key"].tolist(), b["text"].tolist(), strict=True):
                restored, taken, gain = judge.restore(t)
                if taken or LOST in t or _C1.search(t):
                    out.append((k, taken, round(gain, 3), restored, LOST not in restored and not _C1.search(restored)))
            if out:
                yield pd.DataFrame(out, columns=["key", "chain", "gain", "restored", "complete"])

    return doubtful.select("key", "text").mapInPandas(scan, "key string, chain string, gain double, restored string, complete boolean").select(
        F.col("key").cast("bigint").alias(key), "chain", "gain", "restored", "complete"
    )
