"""Language ID with blended-spectrum string kernels.

The kernel of two texts counts the character n-grams (n = 1, 2, 3 blended) that are
present in both, divided by the root of the product of how many each has. Texts are
lower-cased; every letter of every script is a symbol of its own, and what is no letter is one
symbol. N-grams are known by slots, of which there are SPARSE for each n-gram of the landmarks (within bounds); n-grams that
share a slot count as one.

Landmarks are a few texts of each language. The Nyström map takes a text's kernel values
with the landmarks through the inverse root of the landmarks' own kernel matrix;
ridge regression on it, one language against the rest, gives the weights. A batch of texts
is scored by two products of matrices: presence by landmarks, which are sparse, and kernel values by languages.

The fit takes a sample of ``per_language`` labelled texts for each language and of
``fit_bytes`` in all, ``landmarks`` of them for each language and ``most_landmarks`` in all
being landmarks (two of each language at least). All four are parameters; whole texts, chosen by a hash
of doc_id and text, each once. Scoring reads every text whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemosea.llm._common import crc_mod, give_back, mixed, read_table, sliced
from mnemosea.llm.bpe import ragged

#: Fewest and most bits of an n-gram's slot; between them, so many that the landmarks' n-grams take one slot in SPARSE at most.
SLOT_BITS, MOST_SLOT_BITS, SPARSE = 20, 24, 16
ORDERS = (1, 2, 3)
UNDETERMINED = "und"
#: Characters of text that are scored together, unless one text has more.
TOGETHER = 1 << 18
_LETTER = regex.compile(r"\p{L}")


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts one after another, and each text's begin."""
    low = [t.lower() for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate([[0], np.cumsum([len(t) for t in low])]).astype(np.int64)


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    out = np.zeros(0x110000, bool)
    for low in range(0, 0x110000, 1 << 16):
        block = "".join(chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(low, low + (1 << 16)))
        out[[low + m.start() for m in _LETTER.finditer(block)]] = True
    return out


class Spectrum:
    """The distinct n-grams of texts, as slots of so many bits."""

    def __init__(self, bits: int = SLOT_BITS):
        self.is_letter = letters()
        self.bits = bits
        self.place: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"place": None}  # made anew where it is needed

    def hashes(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """For each n, 64-bit hashes of the n-grams from each place on, and where each text begins."""
        points, begin = code_points(texts)
        h = np.where(self.is_letter[points], points, 0).astype(np.uint64)
        symbols, out = h, []
        for n in ORDERS:
            if n > 1:
                h = h[:-1] * np.uint64(0x110001) + symbols[n - 1 :]
            out.append(mixed(h * np.uint64(4) + np.uint64(n)))
        return out, begin

    def grams(self, texts: list[str]) -> list[np.ndarray]:
        """The slots of each text's n-grams, each once."""
        if self.place is None:
            self.place = np.zeros(1 << self.bits, np.int32)
        hashes, begin = self.hashes(texts)
        slots = [(h >> np.uint64(64 - self.bits)).astype(np.int32) for h in hashes]
        out = []
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            own = np.concatenate([s[a : max(a, b - n + 1)] for n, s in zip(ORDERS, slots, strict=True)])
            at = np.arange(len(own), dtype=np.int32)
            self.place[own] = at  # the last place of each slot stays
            out.append(own[self.place[own] == at])
        return out


def slot_bits(texts: list[str]) -> int:
    """Bits of the slots for landmarks with these texts."""
    spectrum = Spectrum()
    found = np.zeros(0, np.uint64)
    for i, j in together(texts):
        found = np.union1d(found, np.concatenate(spectrum.hashes(texts[i:j])[0]))
    return min(MOST_SLOT_BITS, max(SLOT_BITS, (SPARSE * len(found)).bit_length()))


class Model:
    """The fitted classifier; without languages it says ``und``.

    Landmarks are kept by slot: for each slot that any of them has, the numbers of those that have it. What a text shares with all
    landmarks is a count of these numbers over the text's slots.
    """

    def __init__(self, rows: list[tuple[str, str]], landmarks: int, ridge: float, sharpness: float, most_landmarks: int = 512):
        rows = sorted(rows)
        self.languages = sorted({lang for lang, _ in rows})
        self.sharpness = sharpness
        if not rows:
            return
        texts = [t for _, t in rows]
        each = max(2, min(landmarks, most_landmarks // len(self.languages)))
        of: dict[str, list[str]] = {}
        for lang, t in rows:
            of.setdefault(lang, []).append(t)
        chosen = [t for lang in self.languages for t in of[lang][:each]]
        self.spectrum = Spectrum(slot_bits(chosen))
        marks = [g for i, j in together(chosen) for g in self.spectrum.grams(chosen[i:j])]
        slots, owner = np.concatenate(marks), np.repeat(np.arange(len(marks), dtype=np.int32), [len(g) for g in marks])
        order = np.argsort(slots, kind="stable")
        self.known, first = np.unique(slots[order], return_index=True)
        self.edge, self.owner = np.append(first, len(slots)), owner[order]
        self.scale = 1 / np.sqrt(np.maximum(1, [len(g) for g in marks]))
        self.row: np.ndarray | None = None
        own = np.stack([self._shared(g) for g in marks])
        value, vector = np.linalg.eigh(own)
        keep = value > 1e-8 * value.max()
        root = vector[:, keep] / np.sqrt(value[keep])
        z = np.concatenate([self.kernel(texts[i:j]) for i, j in together(texts)]) @ root
        z = np.concatenate([z, np.ones((len(z), 1))], 1)
        target = np.array([[1.0 if lang == own else -1.0 for own in self.languages] for lang, _ in rows])
        weight = np.array([1.0 / len(of[lang]) for lang, _ in rows])
        gram = (z * weight[:, None]).T @ z
        solved = np.linalg.solve(gram + ridge * np.eye(len(gram)), (z * weight[:, None]).T @ target)
        self.weights, self.bias = root @ solved[:-1], solved[-1]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"row": None}  # made anew where it is needed

    def _shared(self, slots: np.ndarray) -> np.ndarray:
        """The kernel of a text, given by its slots, with each landmark."""
        if self.row is None:
            self.row = np.full(1 << self.spectrum.bits, -1, np.int32)
            self.row[self.known] = np.arange(len(self.known), dtype=np.int32)
        row = self.row[slots]
        row = row[row >= 0]
        begin = self.edge[row]
        common = np.bincount(self.owner[ragged(begin, self.edge[row + 1] - begin)], minlength=len(self.scale))
        return common * self.scale / np.sqrt(max(1, len(slots)))

    @property
    def marks(self) -> np.ndarray:
        """The landmarks as columns over their slots, for models small enough."""
        out = np.zeros((len(self.known), len(self.scale)))
        out[np.repeat(np.arange(len(self.known)), np.diff(self.edge)), self.owner] = 1.0
        return out * self.scale

    def kernel(self, texts: list[str]) -> np.ndarray:
        """The kernel of each text with each landmark."""
        return np.stack([self._shared(g) for g in self.spectrum.grams(texts)])

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language of each text and its share in a softmax over the languages."""
        f = np.concatenate([self.kernel(texts[i:j]) for i, j in together(texts)]) @ self.weights + self.bias
        e = np.exp(self.sharpness * (f - f.max(1, keepdims=True)))
        p = e / e.sum(1, keepdims=True)
        best = p.argmax(1)
        return [self.languages[k] for k in best], p[np.arange(len(texts)), best]


def together(texts: list[str]) -> list[tuple[int, int]]:
    """Ranges of texts that are scored at once: 64 at most, and about TOGETHER characters."""
    out, i, room = [], 0, TOGETHER
    for j, t in enumerate(texts):
        if j > i and (j - i == 64 or len(t) > room):
            out.append((i, j))
            i, room = j, TOGETHER
        room -= len(t)
    return [*out, (i, len(texts))] if texts else out


def fit(
    docs: DataFrame, learn: Column, *, per_language: int = 250, landmarks: int = 32, most_landmarks: int = 512, fit_bytes: int = 24 << 20, ridge: float = 1e-3, sharpness: float = 4.0
) -> Model:
    """A model of the rows where ``learn`` holds and lang and text are not null. Rows that repeat
    another's doc_id and text count once."""
    row = F.xxhash64(F.lit(3), "doc_id", "text", "lang")
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang", row.alias("row"), F.octet_length("text").alias("size"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not counts:
        return Model([], landmarks, ridge, sharpness)
    place = (F.shiftrightunsigned("row", 11).cast("double") * F.lit(2.0**-53)).alias("place")
    wanted = 2.0 * per_language + 50
    # Rows are counted with their repetitions; a language is looked at whole if too few of its rows are left without.
    some, short = [], dict.fromkeys(counts, wanted)
    while short:
        rate = F.element_at(F.create_map(*[F.lit(x) for lang, w in short.items() for x in (lang, min(1.0, w / counts[lang]))]), F.col("lang"))
        near = rows.select("lang", "size", "row", place).filter(F.col("lang").isin(*short)).filter(F.col("place") <= rate)
        near = near.groupBy("lang", "row").agg(F.first("size").alias("size"), F.first("place").alias("place"))
        near = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("place", "row"))).filter(F.col("k") <= per_language)
        found = near.collect()  # per_language rows for each language at most
        have = {lang: sum(r["lang"] == lang for r in found) for lang in short}
        some += [r for r in found if have[r["lang"]] >= per_language or short[r["lang"]] >= counts[r["lang"]]]
        short = {lang: w * 64 for lang, w in short.items() if have[lang] < per_language and w < counts[lang]}
    chosen, room = [], fit_bytes
    for r in sorted(some, key=lambda r: (r["k"], r["lang"])):
        if r["size"] <= room:
            chosen.append((r["row"],))
            room -= r["size"]
    ids = docs.sparkSession.createDataFrame(chosen, "chosen long")
    texts = rows.join(F.broadcast(ids), F.col("row") == F.col("chosen"), "left_semi").groupBy("row").agg(F.first("lang").alias("lang"), F.first("text").alias("text"))
    model = Model([(r["lang"], r["text"]) for r in texts.collect()], landmarks, ridge, sharpness, most_landmarks)
    give_back()
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (0 to 1).

    Null texts, and texts without a letter, are ``und`` with score 0, and so is every text if
    the model had nothing to learn from. Equal texts get equal results; repeated rows stay.
    An empty table gives no rows. Only doc_id and text are read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the n-grams of the landmarks, and landmarks times languages

    def run(batches):
        model = held.value
        for batch in sliced(batches, "text", 1 << 20):
            texts = batch.column("text").to_pylist()
            lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            if model.languages:
                some = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
                for k in range(0, len(some), 128):
                    part = some[k : k + 128]
                    names, p = model.predict([texts[i] for i in part])
                    for i, name in zip(part, names, strict=True):
                        lang[i] = name
                    score[part] = p
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op3_langid(spark, sf_dir):
    """All documents; the model learns from those whose crc32(doc_id) mod 3 is not 1."""
    docs = read_table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs, crc_mod(F.col("doc_id"), 3) != 1))
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


#: Below this share of the likeliest language a text counts as of no language that was learnt.
LEAST = 0.3


def keep_identified(docs: DataFrame, model: Model, *, least: float = LEAST) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is of a learnt language with a score of at
    least ``least``. If there was nothing to learn from, all rows stay."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = held.value
        for batch in sliced(batches, "text", 1 << 20):
            texts = batch.column("text").to_pylist()
            keep = np.full(len(texts), not model.languages)
            some = [i for i, t in enumerate(texts) if model.languages and t and _LETTER.search(t)]
            for k in range(0, len(some), 128):
                part = some[k : k + 128]
                keep[part] = model.predict([texts[i] for i in part])[1] >= least
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
