"""Batch scoring of audio chunks with a model the caller supplies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F, types as T

from parlance.functions import audio

# Replies of the stand-in model, by duration bucket, and the text of a failed call.
STUB_REPLIES = (
    "Hello, this is a test.",
    "The quick brown fox jumps over the lazy dog.",
    "Testing speech recognition.",
    "This is mock transcription output.",
    "Voice agent is ready.",
)
FAILURE = "[Transcription error: {}]"
BATCH_SAMPLES = 8_000_000  # samples of a batch, padding included: ten chunks of 50 seconds
HELD_BATCHES = 2


def stub_text(n_samples: Column, rate: int = audio.SAMPLE_RATE) -> Column:
    """Deterministic stand-in for a model: text chosen by tenths of a second, empty below half a second."""
    seconds = n_samples / F.lit(float(rate))
    bucket = (seconds * 10).cast("int") % len(STUB_REPLIES)
    return F.when(seconds < 0.5, "").otherwise(F.element_at(F.array(*map(F.lit, STUB_REPLIES)), bucket + 1))


def stub_transcribe(df: DataFrame, n: str = "n_samples", rate: int = audio.SAMPLE_RATE) -> DataFrame:
    return df.withColumn("text", stub_text(F.col(n), rate))


class _Scorer:
    """A task's model with its answers in one form: ``(text, failed, confidence)`` per chunk."""

    def __init__(self, model: Callable, batch_samples: int, rate: int) -> None:
        self.model, self.batch_samples, self.rate = model, batch_samples, rate

    def _answer(self, given, values: np.ndarray) -> tuple[str, bool, float]:
        text, confidence = given if isinstance(given, tuple) else (given, None)
        return text, False, energy_confidence(values, self.rate) if confidence is None else float(confidence)

    def one(self, values: np.ndarray) -> tuple[str, bool, float]:
        try:
            return self._answer(self.model(values), values)
        except Exception as error:  # noqa: BLE001 - any model failure becomes a row
            return FAILURE.format(error), True, 0.0

    def many(self, chunks: list[np.ndarray]) -> list[tuple[str, bool, float]]:
        if not hasattr(self.model, "batch"):
            return [self.one(c) for c in chunks]
        out: list = [None] * len(chunks)
        for lot in batches_by_length([len(c) for c in chunks], self.batch_samples):
            lengths = np.array([len(chunks[i]) for i in lot])
            padded = np.zeros((len(lot), int(lengths.max(initial=0))), np.float32)
            for row, i in enumerate(lot):
                padded[row, :lengths[row]] = chunks[i]
            try:
                given = list(self.model.batch(padded, lengths))
                if len(given) != len(lot):
                    raise ValueError(f"{len(given)} answers for {len(lot)} chunks")
                answers = [self._answer(g, chunks[i]) for g, i in zip(given, lot)]
            except Exception:  # noqa: BLE001 - one bad chunk must not take its batch along
                answers = [self.one(chunks[i]) for i in lot]
            for i, answer in zip(lot, answers):
                out[i] = answer
        return out


def batches_by_length(lengths: list[int], most: int) -> list[list[int]]:
    """Positions of the chunks, longest first, cut so that a batch has ``most`` samples with its padding, or one chunk."""
    out: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if out and (len(out[-1]) + 1) * lengths[out[-1][0]] <= most:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def energy_confidence(values: np.ndarray, rate: int = audio.SAMPLE_RATE) -> float:
    """``audio.energy_confidence`` of one chunk inside a task."""
    n = len(values)
    if n < 1600:
        return 0.3
    level = min(1.0, float(np.sqrt(np.mean(np.square(values, dtype=np.float64)))) / audio.FULL_RMS)
    seconds = n / rate
    return max(0.1, min(1.0, level * (0.7 if seconds < 0.5 else 0.95 if seconds > 5.0 else 1.0)))


def transcribe(df: DataFrame, load_model: Callable[[], Callable], samples: str = "samples", batch_samples: int = BATCH_SAMPLES,
               rate: int = audio.SAMPLE_RATE) -> DataFrame:
    """Append ``text``, ``failed`` and ``confidence``. ``load_model()`` runs once per Python worker task and returns a model.

    ``model(samples ndarray)`` gives a text, or a text and a confidence. If the model has ``batch(padded, lengths)``, it is called with
    several chunks at once: ``padded`` is an array of rows filled up with zeros, of ``batch_samples`` values at most (a longer chunk
    is a batch of its own), ``lengths`` says how much of each row counts, and the answer is one text, or text and confidence, per row.
    Chunks held back for this are sorted by length, so that little is padded; a task holds ``HELD_BATCHES`` batches of samples.

    A failed batch is called again chunk by chunk. A call that raises yields its message as text, never a failed job; its
    confidence is 0. Without a confidence from the model it follows from level and length (``audio.energy_confidence``).
    """
    added = [T.StructField("text", T.StringType()), T.StructField("failed", T.BooleanType()), T.StructField("confidence", T.DoubleType())]
    kept = [f for f in df.schema.fields if f.name not in {a.name for a in added}]

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = _Scorer(load_model(), batch_samples, rate)
        held, size = [], 0

        def scored(rows: pd.DataFrame) -> pd.DataFrame:
            texts, failed, confidence = zip(*scorer.many([np.asarray(v, np.float32) for v in rows[samples]]))
            return rows[[f.name for f in kept]].assign(text=texts, failed=failed, confidence=confidence)

        for part in parts:
            if not len(part):
                continue
            held.append(part)
            size += sum(map(len, part[samples]))
            if size >= HELD_BATCHES * batch_samples or not hasattr(scorer.model, "batch"):
                yield scored(pd.concat(held, ignore_index=True))
                held, size = [], 0
        if held:
            yield scored(pd.concat(held, ignore_index=True))

    return df.mapInPandas(score, T.StructType([*kept, *added]))
