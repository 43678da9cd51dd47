"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram is bound as the product of its letters'
vectors, rotated by two, one and zero places; a document is the sum (bundle) of its trigrams, a
language's prototype the sum of its documents' unit vectors. Prediction is the prototype with the
greatest cosine. Letters are those of Unicode, lower-cased; each run of other characters is one
boundary symbol.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DIM, SYMBOLS, SEED = 512, 256, 20240
#: Languages whose prototypes are sent to executors: 4 KB each, so 4 MB at most. More raise an error.
MAX_LANGS = 1024
#: Unit vectors are rounded to so many steps, so that sums are exact and reruns agree.
STEPS = 4096
_CACHE: dict = {}


def _tables(dim: int):
    """(symbol of every code point, letter vectors): symbol 0 is the boundary."""
    import numpy as np

    if dim not in _CACHE:
        symbols = np.zeros(0x110000, np.uint8)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = ord(c.lower()[0])
                symbols[cp] = low - 96 if 97 <= low <= 122 else 27 + low * 2654435761 % 2**32 % (SYMBOLS - 27)
        vectors = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, dim))
        _CACHE[dim] = symbols, vectors
    return _CACHE[dim]


def encode(texts: list, dim: int = DIM):
    """(unit vectors of the texts, whether each has a letter). Texts are UTF-8 bytes or None."""
    import numpy as np

    symbols, letters = _tables(dim)
    parts, lengths = [], []
    for t in texts:
        s = symbols[np.frombuffer((t or b"").decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)]
        s = np.concatenate(([0], s, [0])).astype(np.int64)
        s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]
        parts.append(s)
        lengths.append(len(s))
    vectors = np.zeros((len(texts), dim), np.float32)
    grams = [(s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:] for s in parts]
    owner = np.repeat(np.arange(len(texts)), [len(g) for g in grams])
    if not len(owner):
        return vectors, np.zeros(len(texts), bool)
    gram = np.concatenate(grams)
    space = SYMBOLS**3
    keys, counts = np.unique(owner * space + gram, return_counts=True)
    kinds, which = np.unique(keys % space, return_inverse=True)
    docs = keys // space
    for at in range(0, len(kinds), 4096):  # the table of bound vectors stays small
        k = kinds[at : at + 4096]
        bound = np.roll(letters[k // SYMBOLS**2], 2, 1) * np.roll(letters[k // SYMBOLS % SYMBOLS], 1, 1) * letters[k % SYMBOLS]
        here = (which >= at) & (which < at + 4096)
        dense = np.zeros((len(texts), len(k)), np.float32)
        dense[docs[here], which[here] - at] = counts[here]
        vectors += dense @ bound.astype(np.float32)
    lettered = np.array([bool(p.any()) for p in parts])
    norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
    return (vectors / np.maximum(norm, 1e-9)[:, None]).astype(np.float32), lettered


def prototypes(labelled: DataFrame, dim: int = DIM) -> dict[str, list[int]]:
    """Learned from all rows of (text, lang); partial sums stay on the executors, the driver gets `dim` numbers a language."""
    common.tune(labelled.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        sums: dict = {}

        def flush():
            for lang, v in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * dim), pa.array(range(dim), pa.int32()), pa.array(v)], ["lang", "i", "v"])
            sums.clear()

        for cols, texts in common.slices(batches):
            vectors, ok = encode(texts, dim)
            steps = np.rint(vectors * STEPS).astype(np.int64)
            langs = np.array(cols["lang"], object)
            for lang in set(langs[ok]):
                got = steps[ok & (langs == lang)].sum(0)
                sums[lang] = sums[lang] + got if lang in sums else got
            if len(sums) > MAX_LANGS:
                yield from flush()
        yield from flush()

    parts = labelled.where("lang is not null").select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(run, "lang string, i int, v long")
    each = common.stored(parts.groupBy("lang", "i").agg(F.sum("v").alias("v")), "prototypes")
    n = each.select("lang").distinct().limit(MAX_LANGS + 1).count()
    if n > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    out: dict[str, list[int]] = {}
    for r in each.collect():
        out.setdefault(r["lang"], [0] * dim)[r["i"]] = r["v"]
    return out


def identify(docs: DataFrame, learned: dict[str, list[int]], dim: int = DIM) -> DataFrame:
    """`docs` has doc_id, text and held_out. Adds lang_pred and score, the cosine (below 0: 0).

    Null text, text without a letter, or nothing learned: `und`, score 0. Equal cosines: the
    language that sorts first. Every row of `docs` gives one row.
    """
    names = sorted(learned)
    common.tune(docs.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        protos = np.array([learned[k] for k in names], np.float64).reshape(len(names), dim)
        protos = (protos / np.maximum(np.sqrt((protos**2).sum(1)), 1e-9)[:, None]).astype(np.float32)
        for cols, texts in common.slices(batches):
            vectors, ok = encode(texts, dim)
            if names:
                cos = vectors @ protos.T
                best = cos.argmax(1)
                score = np.clip(cos[np.arange(len(best)), best], 0, 1)
                lang = [names[b] if o else "und" for b, o in zip(best, ok)]
                score = np.where(ok, score, 0.0)
            else:
                lang, score = ["und"] * len(texts), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([pa.array(cols["doc_id"], pa.int64()), pa.array(cols["held_out"], pa.bool_()), pa.array(lang), pa.array(score.astype(np.float64))], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame, dim: int = DIM) -> DataFrame:
    """Learns from rows whose id's crc32 modulo 3 is not 1 and predicts all rows. Extra columns are ignored."""
    held = common.remainder(F.col("doc_id"), 3) == 1
    learned = prototypes(docs.where(~held), dim)
    return identify(docs.select("doc_id", "text", held.alias("held_out")), learned, dim)
