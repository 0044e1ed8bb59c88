"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary, with its word-start mark.
Each language has a probability for each piece, fitted by expectation
maximisation over all segmentations of the words of labelled documents; a text's
likelihood is the product over its words of the forward sum over all ways to cut
the word into pieces. Pieces never cross words, so this is the exact sum over
all segmentations of the text; sums over very long words are rescaled as they
go. New words are scored together, as arrays over all (word, start, end), and
remembered.

The fit uses at most ``FIT_DOCS`` labelled documents of each language, those
chosen by a hash of doc_id (about that many, as the hash falls); each chosen
document is used whole, with all its words, and every language has its column,
so the model grows with the number of languages (33,000 numbers each).

Defined cases: text that is null or has no letter is ``und`` with score 0; with
no labelled document everything is ``und``; ties go to the language first in
order; repeated rows are scored alike; extra columns are not looked at.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.batches import bound
from graphloom.llm.words import Known, code_points

FIT_DOCS, ROUNDS = 1500, 3
VOCABULARY = "piece_bpe_32k.model"
MARK, SAFE = "▁", 40  # words up to SAFE letters can't leave the range of floating-point numbers
UNSEEN, SOFT = 1e-7, 0.05
MIX = np.uint64(0xBF58476D1CE4E5B9)
KEEP_WORDS, KEEP_LETTERS, CHUNK, CELLS = 600_000, 1 << 23, 1 << 20, 1 << 22

_letters: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """A flag for each code point."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def runs_of(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters: the texts in lower case as one, its code points, and start, end and text of each run."""
    low = [t.lower() for t in texts]
    joined = "\n".join(low)
    cp = code_points(joined)
    inside = np.zeros(len(cp) + 2, dtype=np.int8)
    inside[1:-1] = is_letter()[cp]
    turn = np.diff(inside)
    at, stop = np.flatnonzero(turn > 0), np.flatnonzero(turn < 0)
    ends = np.cumsum(np.fromiter(map(len, low), dtype=np.int64, count=len(low)) + 1)
    return joined, cp, at, stop, np.searchsorted(ends, at, side="right")


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case."""
    joined, _, at, stop, _ = runs_of([text or ""])
    return [joined[a:b] for a, b in zip(at.tolist(), stop.tolist(), strict=True)]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces_of(path: str) -> list[str]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


class Lattice:
    """All pieces that match inside words, for many words at a time.

    Every beginning of a piece is a node of a trie; a step goes from a node and
    a letter, together one number, to the next node. Places where no piece can
    go on are left out at once.
    """

    BITS = 20

    def __init__(self, pieces: list[str]) -> None:
        pieces = sorted({p for p in pieces if p})
        self.n = len(pieces)  # the number after the last is any other single letter
        steps: dict[int, int] = {}
        ends: dict[int, int] = {}
        for i, p in enumerate(pieces):
            node = 0
            for c in p:
                node = steps.setdefault(node << 21 | ord(c) + 1, len(steps) + 1)
            ends[node] = i
        self.piece = np.full(len(steps) + 1, -1, dtype=np.int32)
        self.piece[list(ends)] = list(ends.values())
        keys = np.array(list(steps), dtype=np.uint64)
        bucket = self._bucket(keys)
        order = np.argsort(bucket, kind="stable")
        held = np.bincount(bucket, minlength=1 << self.BITS)
        self.first, self.most = (np.cumsum(held) - held).astype(np.int32), int(held.max(initial=0))
        self.keys = np.append(keys[order], np.zeros(self.most, np.uint64))
        self.node = np.append(np.array(list(steps.values()), dtype=np.int64)[order], np.full(self.most, -1, np.int64))
        self.longest = max(map(len, pieces), default=1)

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        return (((h ^ (h >> np.uint64(29))) * MIX) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def _find(self, key: np.ndarray) -> np.ndarray:
        """The node that each step leads to, or -1."""
        at = self.first[self._bucket(key)]
        out = np.full(len(key), -1, dtype=np.int64)
        for k in range(self.most):
            out = np.where(self.keys[at + k] == key, self.node[at + k], out)
        return out

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]]:
        """For ``(end, length)``, rising: words, starting places and pieces.

        Word ``w`` has the places ``base[w]`` to ``base[w] + size[w]`` in arrays over all places.
        """
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        base = np.cumsum(size + 1) - size - 1
        code = code_points("".join([MARK + w + "\n" for w in words])).astype(np.uint64) + np.uint64(1)
        word = np.repeat(np.arange(len(words)), size + 1)
        at = np.flatnonzero(code != np.uint64(11))
        left = (base + size)[word[at]] - at
        node, length, found = np.zeros(len(at), dtype=np.int64), 0, []
        while len(at):
            length += 1
            node = self._find(node.astype(np.uint64) << np.uint64(21) | code[at + (length - 1)])
            number = np.where(node >= 0, self.piece[node], -1)
            hit = np.ones(len(at), dtype=bool) if length == 1 else number >= 0
            if hit.any():
                found.append((at[hit], length, np.where(number[hit] >= 0, number[hit], self.n)))
            go = (node >= 0) & (left > length)
            at, node, left = at[go], node[go], left[go]
        out = []
        for start, length, piece in found:
            w = word[start]
            end = start - base[w] + length
            order = np.argsort(end.astype(np.uint16) if end.max() < 1 << 16 else end, kind="stable")
            end = end[order]
            cut = np.flatnonzero(np.append(True, end[1:] != end[:-1]))
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(end)], strict=True):
                part = order[a:b]
                out.append((int(end[a]), length, w[part], start[part], piece[part]))
        out.sort(key=lambda e: (e[0], e[1]))
        return base, size, out


class _Scale:
    """Keeps sums over segmentations of long words in range: each place has the logarithm of its factor."""

    def __init__(self, lattice: Lattice, base: np.ndarray, size: np.ndarray, shape: tuple[int, int]) -> None:
        self.long = np.flatnonzero(size > SAFE)
        self.base, self.size, self.reach = base, size, lattice.longest
        self.every = max(1, SAFE - self.reach)
        self.log = np.zeros(shape) if len(self.long) else None
        self.word = np.zeros((len(size), shape[1])) if len(self.long) else None

    def step(self, values: np.ndarray, t: int, way: int) -> None:
        """After the place ``t`` letters from the word's begin (``way`` 1) or end (-1)."""
        if self.log is None:
            return
        w = self.long[self.size[self.long] >= t]
        at = (self.base[w] if way > 0 else self.base[w] + self.size[w]) + way * t
        self.log[at] = self.word[w]
        if t % self.every == 0 and len(w):
            near = at[:, None] - way * np.arange(min(self.reach, t + 1))[None, :]
            most = np.maximum(values[near].max(axis=1), 1e-300)
            values[near] = values[near] / most[:, None, :]
            self.word[w] += np.log(most)
            self.log[near] += np.log(most)[:, None, :]


def _by_end(edges):
    """Edges by their end, each with its list."""
    at = 0
    while at < len(edges):
        to = at
        while to < len(edges) and edges[to][0] == edges[at][0]:
            to += 1
        yield edges[at][0], edges[at:to]
        at = to


def forward(lattice: Lattice, p: np.ndarray, words: list[str], edges=None):
    """Log of the sum over segmentations, a column a language, for ``p[language, piece]``; then sums and scale by place."""
    base, size, found = edges or lattice.edges(words)
    by_piece = np.ascontiguousarray(p.T)
    alpha = np.zeros((int((size + 1).sum()), len(p)))
    alpha[base] = 1.0
    scale = _Scale(lattice, base, size, alpha.shape)
    for end, some in _by_end(found):
        for _, length, _, start, piece in some:
            alpha[start + length] += alpha[start] * by_piece[piece]
        scale.step(alpha, end, 1)
    total = np.log(np.maximum(alpha[base + size], 1e-300))
    return total + (scale.log[base + size] if scale.log is not None else 0.0), alpha, scale


def _expected(lattice: Lattice, p: np.ndarray, words: list[str], weight: np.ndarray) -> np.ndarray:
    """How often each piece is used, over all segmentations of the words."""
    base, size, found = edges = lattice.edges(words)
    total, alpha, up = forward(lattice, p[None, :], words, edges)
    beta = np.zeros((len(alpha), 1))
    beta[base + size] = 1.0
    down = _Scale(lattice, base, size, beta.shape)
    out = np.zeros(lattice.n + 1)
    from_end: dict[int, list] = {}
    for end, length, w, start, piece in found:  # by the distance of their start from the word's end
        far = size[w] - (end - length)
        order = np.argsort(far, kind="stable")
        cut = np.flatnonzero(np.append(True, np.diff(far[order]) != 0))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(far)], strict=True):
            part = order[a:b]
            from_end.setdefault(int(far[part[0]]), []).append((length, w[part], start[part], piece[part]))
    for far in sorted(from_end):
        for length, _, start, piece in from_end[far]:
            beta[start, 0] += beta[start + length, 0] * p[piece]
        down.step(beta, far, -1)
    for _, length, w, start, piece in found:
        a, b = alpha[start, 0], beta[start + length, 0]
        if up.log is None:
            got = a * p[piece] * b / np.exp(total[w, 0])
        else:
            with np.errstate(divide="ignore"):
                got = np.exp(np.log(a) + np.log(p[piece]) + np.log(b) + up.log[start, 0] + down.log[start + length, 0] - total[w, 0])
        got *= weight[w]
        out += np.bincount(piece, weights=got, minlength=lattice.n + 1)
    return out


def _chunks(words: list[str], columns: int = 1):
    """Places of words of like length, with a bounded number of cells."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    part, cells = [], 0
    for i in order:
        part.append(i)
        cells += (len(words[i]) + 2) * columns
        if cells >= CELLS // 8:
            yield part
            part, cells = [], 0
    if part:
        yield part


def fit(counts: dict[str, dict[str, int]], lattice: Lattice, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the piece probabilities of each."""
    langs = sorted(counts)
    out = np.empty((len(langs), lattice.n + 1))
    for k, lang in enumerate(langs):
        words = sorted(counts[lang])
        weight = np.array([counts[lang][w] for w in words], dtype=float)
        parts = list(_chunks(words))
        p = np.full(lattice.n + 1, 1.0 / (lattice.n + 1))
        for _ in range(rounds):
            expected = np.zeros(lattice.n + 1)
            for part in parts:
                expected += _expected(lattice, p, [words[i] for i in part], weight[part])
            expected += UNSEEN * max(1.0, expected.sum())
            p = expected / expected.sum()
        out[k] = p
    return langs, out


class Scorer:
    """Languages of texts; words are remembered by worker."""

    def __init__(self, path: str, langs: list[str], p: np.ndarray) -> None:
        self.lattice, self.langs, self.p = Lattice(pieces_of(path)), langs, p
        self.known, self.rows = Known(), np.zeros((0, len(langs)))

    def _learn(self, words: list[str]) -> None:
        new = np.empty((len(words), len(self.langs)))
        for part in _chunks(words, len(self.langs)):
            new[part] = forward(self.lattice, self.p, [words[i] for i in part])[0]
        self.rows = np.concatenate([self.rows, new])

    def _likelihoods(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The logarithms' sums of each text, and which texts have a letter."""
        joined, cp, at, stop, text = runs_of(texts)
        out = np.zeros((len(texts), len(self.langs)))
        some = np.zeros(len(texts), dtype=bool)
        if len(at):
            if len(self.known) > KEEP_WORDS or self.known.used > KEEP_LETTERS:
                self.known, self.rows = Known(), np.zeros((0, len(self.langs)))
            number, new = self.known.numbers(cp, at, stop)
            if len(new):
                self._learn([joined[a:b] for a, b in zip(at[new].tolist(), stop[new].tolist(), strict=True)])
            step = max(1, CELLS // len(self.langs))
            for lo in range(0, len(number), step):
                of = text[lo : lo + step]
                cut = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                out[of[cut]] += np.add.reduceat(self.rows[number[lo : lo + step]], cut, axis=0)
            some[text] = True
        return out, some

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        out, part, held = [], [], 0
        for t in [*texts, None]:
            if len(out) + len(part) < len(texts):
                part.append(t or "")
                held += len(part[-1])
            if held < CHUNK and len(out) + len(part) < len(texts):
                continue
            for ll, some in zip(*self._likelihoods(part), strict=True) if part else ():
                if not some:
                    out.append(("und", 0.0))
                    continue
                ll = SOFT * (ll - ll.max())  # words of a text are not independent, so a text's evidence is tempered
                best = int(ll.argmax())
                out.append((self.langs[best], float(1.0 / np.exp(ll).sum())))
            part, held = [], 0
        return out


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


_models: dict[str, Scorer] = {}


def train(docs: DataFrame, fit_docs: int = FIT_DOCS, vocabulary: str | None = None) -> tuple[list[str], np.ndarray]:
    """Fits on at most ``fit_docs`` documents a language that have a lang and aren't held out."""
    bound(docs.sparkSession)
    path = vocabulary or vocabulary_path()
    labelled = docs.where(F.col("lang").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()}  # a row for each language
    key = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("langid")), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, float(fit_docs) / n * (1 << 30))]) if sizes else None
    if not sizes:
        return [], np.zeros((0, 1))
    chosen = labelled.where(key <= share[F.col("lang")])  # about fit_docs a language, whatever the table's size

    def count(batches):
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                found = Counter()
                for text in texts:
                    found.update(words_of(text))
                if found:
                    yield pd.DataFrame({"lang": [lang] * len(found), "word": list(found), "n": list(found.values())})

    counted = chosen.select("lang", "text").mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def fitted(pdf):
        """A language's words of the bounded sample; the columns' order doesn't matter, words are sorted."""
        langs, p = fit({pdf["lang"].iloc[0]: dict(zip(pdf["word"], pdf["n"].tolist(), strict=True))}, Lattice(pieces_of(path)))
        return pd.DataFrame({"lang": langs, "p": list(p)})

    rows = counted.groupBy("lang").applyInPandas(fitted, "lang string, p array<double>").orderBy("lang").collect()  # languages x pieces
    return [r["lang"] for r in rows], np.array([r["p"] for r in rows]) if rows else np.zeros((0, 1))


def identify(docs: DataFrame, langs: list[str], p: np.ndarray, vocabulary: str | None = None, keep=(), names=("lang_pred", "score")) -> DataFrame:
    """``docs`` with the language and its score under ``names``; columns in ``keep`` come along."""
    spark = docs.sparkSession
    bound(spark)
    model = spark.sparkContext.broadcast((langs, p.astype(np.float32)))  # languages x pieces, both bounded
    fields = [f for f in docs.schema.fields if f.name in keep]
    schema = T.StructType([*[T.StructField(f"x{i}", f.dataType) for i, f in enumerate(fields)], T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
    name = f"{id(model)}-{model._jbroadcast.id() if model._jbroadcast is not None else 0}"

    def run(batches):
        if name not in _models:
            _models.clear()
            got_langs, got_p = model.value
            _models[name] = Scorer(vocabulary or vocabulary_path(), got_langs, got_p.astype(float))
        scorer = _models[name]
        for pdf in batches:
            got = scorer.score(pdf["text"].tolist())
            out = pdf[[f"x{i}" for i in range(len(fields))]].copy()
            out["lang"], out["score"] = [g[0] for g in got], [g[1] for g in got]
            yield out

    kept = [F.col(f"`{f.name}`").alias(f"x{i}") for i, f in enumerate(fields)]
    return docs.select(*kept, "text").mapInPandas(run, schema).toDF(*[f.name for f in fields], *names)


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    langs, p = train(docs)
    return identify(docs, langs, p, keep=("doc_id",)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
