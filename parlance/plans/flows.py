"""End-to-end flows: corpus transcription, live sessions, artifact checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import audio
from parlance.operators import conversations, manifests, segments, transcribe, transcripts
from parlance.session import written
from parlance.sources import ranges, recordings

WHOLE_UP_TO = 960_000


class _Gated:
    """A model that gives the refusal text for audio the model would refuse, instead of a call."""

    def __init__(self, model: Callable) -> None:
        self.model = model
        if hasattr(model, "batch"):
            self.batch = self._batch

    @staticmethod
    def refusal(n: int) -> str | None:
        frames = (n - audio.WINDOW) // audio.HOP + 1 if n >= audio.WINDOW else 0
        if frames == 0:
            return ""
        if frames < audio.MIN_FRAMES:
            return audio.TOO_SHORT
        return audio.TOO_LONG if frames > audio.MAX_FRAMES else None

    def __call__(self, samples):
        refused = self.refusal(len(samples))
        return self.model(samples) if refused is None else refused

    def _batch(self, padded, lengths):
        out = [self.refusal(int(n)) for n in lengths]
        asked = [i for i, refused in enumerate(out) if refused is None]
        if asked:
            for i, answer in zip(asked, self.model.batch(padded[asked, :lengths[asked].max()], lengths[asked]), strict=True):
                out[i] = answer
        return out


def gated(load_model: Callable[[], Callable]) -> Callable[[], Callable]:
    return lambda: _Gated(load_model())


def transcribe_recordings(clips: DataFrame, load_model: Callable[[], Callable], key: Sequence[str] = ("session_id", "turn_number"),
                          fraction: float = transcripts.FLOW_FRACTION, whole_up_to: int = WHOLE_UP_TO, gate: bool = True, **plan) -> DataFrame:
    """Recordings with ``content`` -> key, ``reject_reason``, ``chunks``, ``text``, ``confidence``: one merged transcript per recording.

    Each planned chunk's byte range is cut out where the file was read and dealt out by recording and chunk, so a long
    recording is decoded and scored by many tasks; then texts are shuffled by recording for the merge. A recording that went
    to the model in chunks carries the failure marker of a failed chunk into the merge; one that went whole gets the
    failure text. Rejected and empty recordings keep a row, without chunks and with an empty text. ``gate=False`` leaves the
    refusal of short and long audio to the model. ``confidence`` is the mean over the chunks, weighted by their frames.

    Files beyond what a row can hold are for ``scan_and_transcribe``, which reads them by byte range.
    """
    headers = recordings.wav_header(clips.select(*key, "content"))
    return _transcribed(recordings.decode_pcm(headers.withColumn("clip_reject", F.col("reject_reason")), whole_up_to=whole_up_to, keep_rejected=True, spread=True, **plan),
                        load_model, key, fraction, gate)


def _transcribed(chunks: DataFrame, load_model: Callable[[], Callable], key: Sequence[str], fraction: float, gate: bool) -> DataFrame:
    whole = (F.col("start_frame") == 0) & (F.col("end_frame") == F.col("clip_frames"))
    # What a rejected recording's stand-in chunk says is dropped: there was nothing to score.
    text = F.when(F.col("clip_frames").isNull(), "").when(F.col("failed") & ~whole, transcripts.tx.FAILED_CHUNK).otherwise(F.col("text"))
    frames = F.coalesce(F.col("end_frame") - F.col("start_frame"), F.lit(0))
    # Written once: the model must not run again for each of the passes below.
    scored = written(transcribe.transcribe(chunks, gated(load_model) if gate else load_model).select(
        F.to_json(F.struct(*key, "clip_reject", "clip_frames")).alias("clip_id"), "chunk_idx", text.alias("text"), "confidence", frames.alias("frames")), "scored")
    merged = transcripts.merge_transcripts(scored.select("clip_id", "chunk_idx", "text"), fraction)
    sure = scored.groupBy("clip_id").agg(F.try_divide(F.sum(F.col("confidence") * F.col("frames")), F.sum("frames")).alias("confidence"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.select(*key).schema.fields)
    known = merged.join(sure, "clip_id").select(F.from_json("clip_id", f"{schema}, clip_reject string, clip_frames long").alias("k"), "chunks", "text", "confidence")
    return known.select(*[F.col(f"k.{c}").alias(c) for c in key], F.col("k.clip_reject").alias("reject_reason"),
                        F.when(F.col("k.clip_frames").isNull(), F.lit(0)).otherwise(F.col("chunks")).cast("long").alias("chunks"), "text", "confidence")


def scan_and_transcribe(spark: SparkSession, root: str, load_model: Callable[[], Callable], key: Sequence[str] = ("session_id", "turn_number"),
                        fraction: float = transcripts.FLOW_FRACTION, whole_up_to: int = WHOLE_UP_TO, gate: bool = True, **plan) -> DataFrame:
    """``transcribe_recordings`` for the files below ``root``, read by byte range: a recording may have any length."""
    chunks = ranges.read_chunks(spark, root, whole_up_to=whole_up_to, keep_rejected=True, **plan)
    return _transcribed(chunks.withColumn("clip_reject", F.col("reject_reason")), load_model, key, fraction, gate)


def live_session_turns(chunks: DataFrame, control: DataFrame, say: Callable[[DataFrame], DataFrame], gap_ms: int = segments.GAP_MS,
                       capacity: int = segments.CAPACITY, reply: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Live chunks and control messages -> output messages of every turn.

    A closed pause segment is a turn at the time of its last chunk. ``say`` gets the turns (``session_id, segment, ts,
    event_id, n_samples``) and adds ``transcript`` and, if it likes, ``confidence`` and ``realtime_mode`` - from a model
    (``transcribe.transcribe`` on the segment's samples), or from a table of transcripts. Turns are numbered, get the
    settings in force, and are routed; ``reply(smart_model, transcript)`` is the answer in smart mode. Input ``event_id``
    orders simultaneous rows.
    """
    bounded = segments.bounded_segments(segments.segment_on_pause(chunks, gap_ms), capacity)
    turns = bounded.groupBy("session_id", "segment").agg(
        F.max(F.struct(F.col("received_at").alias("ts"), F.col("chunk_no").alias("event_id"))).alias("last"),
        F.sum("accepted").alias("n_samples")).select("session_id", "segment", "last.*", "n_samples")
    said = say(turns)
    defaults = {"confidence": F.lit(1.0), "realtime_mode": F.lit(False)}
    said = said.withColumns({c: v for c, v in defaults.items() if c not in said.columns}).drop("segment")
    # Turns are few compared with chunks and every step below orders them anew: written once, read by each.
    said = written(said, "turns")
    known = conversations.config_as_of(conversations.number_turns(said), control)
    answer = reply or (lambda model, text: F.concat(model, F.lit(": "), text))
    ready = known.select("session_id", "turn_number", "transcript", answer(F.col("smart_model"), F.col("transcript")).alias("reply"),
                         "confidence", "smart_mode", "realtime_mode")
    return conversations.route_turns(ready)


def ensure_artifacts(manifest: DataFrame, files: DataFrame, results: DataFrame, auto_download: bool = True) -> DataFrame:
    audit = manifests.audit_completeness(manifest, files)
    return manifests.ensure_summary(manifest, audit, results, auto_download)
