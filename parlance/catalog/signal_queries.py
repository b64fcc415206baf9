"""Signal, spectrum and chunk-plan queries over ``lineitem`` samples and ``embeddings`` vectors."""

from pyspark.sql import functions as F

from parlance import proxies
from parlance.catalog.registry import register
from parlance.functions import audio
from parlance.operators import chunks, signal, spectrum, transcribe

SAMPLES = """px_samples AS (
  SELECT l_suppkey AS clip_id,
         row_number() OVER (PARTITION BY l_suppkey
           ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) - 1 AS idx,
         (l_quantity - 25.5) / 25.5 AS amp
  FROM lineitem)"""

# A small analysis setting, so that clips of some 600 samples have a dozen frames.
SMALL = {"n_fft": 128, "win": 100, "hop": 40}
SMALL_MELS = 20


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@register("downmix", f"""WITH {SAMPLES}
SELECT clip_id, idx // 2 AS idx,
       round(CASE WHEN count(*) = 2 THEN avg(amp) ELSE arg_min(amp, idx % 2) END, 6) AS amp
FROM px_samples GROUP BY ALL""")
def downmix(spark, sf):
    stereo = proxies.samples(spark, sf).select(
        "clip_id", (F.col("idx") % 2).alias("channel"), audio.div(F.col("idx"), 2).alias("idx"), "amp"
    )
    return rounded(signal.downmix(stereo), "amp")


@register("downmix_arrays", """
SELECT a.vec_id AS clip_id, CAST(i AS BIGINT) AS idx,
       round((CAST(a.embedding[i + 1] AS DOUBLE) + CAST(a.embedding[i + 33] AS DOUBLE)) / 2.0, 6) AS amp
FROM embeddings a, range(32) r(i)""")
def downmix_arrays(spark, sf):
    wide = proxies.vectors(spark, sf).withColumn("samples", F.col("samples").cast("array<double>"))
    mono = audio.downmix_arrays(F.slice("samples", 1, 32), F.slice("samples", 33, 32))
    return rounded(
        wide.select("clip_id", F.posexplode(mono).alias("idx", "amp")).withColumn("idx", F.col("idx").cast("long")), "amp"
    )


@register("quantize_pcm16", f"""WITH {SAMPLES}
SELECT clip_id, idx, CAST(trunc(greatest(least(amp * 1.25, 1.0), -1.0) * 32767.0) AS INTEGER) AS pcm FROM px_samples""")
def quantize_pcm16(spark, sf):
    loud = proxies.samples(spark, sf).withColumn("amp", F.col("amp") * 1.25)
    return signal.quantize(loud).select("clip_id", "idx", "pcm")


def _resample_sql(src, dst):
    ratio = f"(CAST({src} AS DOUBLE) / {dst})"
    return f"""WITH {SAMPLES},
lens AS (SELECT clip_id, CAST(trunc(count(*) / {ratio}) AS BIGINT) AS n_out FROM px_samples GROUP BY clip_id),
outs AS (SELECT clip_id, i, i * {ratio} AS pos FROM lens, LATERAL (SELECT unnest(range(n_out)) AS i))
SELECT o.clip_id, o.i AS idx,
       round(CASE WHEN b.amp IS NULL THEN a.amp
             ELSE a.amp * (1 - (pos - floor(pos))) + b.amp * (pos - floor(pos)) END, 6) AS amp
FROM outs o JOIN px_samples a ON a.clip_id = o.clip_id AND a.idx = CAST(floor(pos) AS BIGINT)
LEFT JOIN px_samples b ON b.clip_id = o.clip_id AND b.idx = CAST(floor(pos) AS BIGINT) + 1"""


@register("resample_linear", _resample_sql(44100, 16000))
def resample_linear(spark, sf, **blocks):
    return rounded(signal.resample_linear(proxies.samples(spark, sf), 44100, 16000, **blocks), "amp")


@register("resample_linear_up", _resample_sql(8000, 16000))
def resample_linear_up(spark, sf, **blocks):
    return rounded(signal.resample_linear(proxies.samples(spark, sf), 8000, 16000, **blocks), "amp")


def _frames_cte(win, hop, name="framed"):
    return f"""lens AS (SELECT clip_id, count(*) AS n FROM px_samples GROUP BY clip_id),
frame_list AS (SELECT clip_id, f AS frame FROM lens, LATERAL (SELECT unnest(range((n - {win}) // {hop} + 1)) AS f)
               WHERE n >= {win}),
{name} AS (SELECT l.clip_id, l.frame, s.idx - l.frame * {hop} AS pos, s.amp
           FROM frame_list l JOIN px_samples s ON s.clip_id = l.clip_id
            AND s.idx >= l.frame * {hop} AND s.idx < l.frame * {hop} + {win})"""


@register("frame_signal", f"""WITH {SAMPLES}, {_frames_cte(100, 40)}
SELECT clip_id, frame, pos, round(amp, 6) AS amp FROM framed""")
def frame_signal(spark, sf, **blocks):
    return rounded(signal.frame_signal(proxies.samples(spark, sf), 100, 40, **blocks), "amp")


@register("frame_arrays", """
SELECT vec_id AS clip_id, CAST(f AS INTEGER) AS frame, round(list_sum(list_transform(
         embedding[f * 8 + 1 : f * 8 + 16], lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS energy
FROM embeddings, range(7) r(f)""")
def frame_arrays(spark, sf):
    frames = proxies.vectors(spark, sf).select(
        "clip_id", F.posexplode(audio.frame_arrays(F.col("samples"), 16, 8)).alias("frame", "samples")
    )
    energy = audio.mean_square_array(F.col("samples")) * F.size("samples")
    return frames.select("clip_id", "frame", F.round(energy, 6).alias("energy"))


@register("rms", f"""WITH {SAMPLES}
SELECT clip_id, count(*) AS n_samples, round(sqrt(avg(amp * amp)), 6) AS rms,
       round(least(1.0, sqrt(avg(amp * amp)) / 0.1), 6) AS rms_capped
FROM (SELECT clip_id, amp * 0.15 AS amp FROM px_samples) GROUP BY clip_id""")
def rms(spark, sf):
    quiet = proxies.samples(spark, sf).withColumn("amp", F.col("amp") * 0.15)
    return rounded(signal.rms(quiet), "rms", "rms_capped")


@register("frame_rms", f"""WITH {SAMPLES}, {_frames_cte(100, 40)}
SELECT clip_id, frame, round(sqrt(avg(amp * amp)), 6) AS rms,
       round(least(1.0, sqrt(avg(amp * amp)) / 0.1), 6) AS rms_capped
FROM (SELECT clip_id, frame, amp * 0.15 AS amp FROM framed) GROUP BY clip_id, frame""")
def frame_rms(spark, sf):
    quiet = proxies.samples(spark, sf).withColumn("amp", F.col("amp") * 0.15)
    return rounded(signal.frame_rms(quiet, 100, 40), "rms", "rms_capped")


_ENERGY_SQL = f"""SELECT clip_id, avg(e) AS frame_energy FROM
  (SELECT clip_id, frame, least(1.0, sqrt(avg(amp * amp)) / 0.1) AS e FROM framed GROUP BY clip_id, frame)
  GROUP BY clip_id"""
_QUIET = SAMPLES.replace("(l_quantity - 25.5) / 25.5", "(l_quantity - 25.5) / 25.5 * 0.15")


def _quiet(spark, sf):
    return proxies.samples(spark, sf).withColumn("amp", F.col("amp") * 0.15)


@register("mean_frame_energy", f"""WITH {_QUIET}, {_frames_cte(512, 256)}, energy AS ({_ENERGY_SQL})
SELECT l.clip_id, round(coalesce(frame_energy, 0.0), 6) AS frame_energy
FROM lens l LEFT JOIN energy e ON e.clip_id = l.clip_id""")
def mean_frame_energy(spark, sf):
    return rounded(signal.mean_frame_energy(_quiet(spark, sf)), "frame_energy")


_CROSSINGS = """crossings AS (
  SELECT clip_id, count(*) AS n_samples, count(*) FILTER (WHERE prev >= 0 AND amp < 0 OR prev < 0 AND amp >= 0) AS crossings
  FROM (SELECT clip_id, amp, lag(amp) OVER (PARTITION BY clip_id ORDER BY idx) AS prev FROM px_samples) GROUP BY clip_id)"""


@register("zero_crossing_rate", f"""WITH {SAMPLES}, {_CROSSINGS}
SELECT clip_id, n_samples, crossings, round(least(1.0, crossings / (n_samples / 2.0)), 6) AS zcr FROM crossings""")
def zero_crossing_rate(spark, sf, **blocks):
    return rounded(signal.zero_crossing_rate(proxies.samples(spark, sf), **blocks), "zcr")


@register("zero_crossing_rate_arrays", """
WITH v AS (SELECT vec_id AS clip_id, i, embedding[i] AS a, embedding[i + 1] AS b FROM embeddings, range(1, 64) r(i))
SELECT clip_id, count(*) FILTER (WHERE a >= 0 AND b < 0 OR a < 0 AND b >= 0) AS crossings,
       round(least(1.0, count(*) FILTER (WHERE a >= 0 AND b < 0 OR a < 0 AND b >= 0) / 32.0), 6) AS zcr
FROM v GROUP BY clip_id""")
def zero_crossing_rate_arrays(spark, sf):
    hits = audio.crossings_array(F.col("samples")).cast("long")
    vectors = proxies.vectors(spark, sf).select("clip_id", hits.alias("crossings"), F.size("samples").alias("n"))
    zcr = audio.crossing_ratio(F.col("crossings"), F.col("n"))
    return vectors.select("clip_id", "crossings", F.round(zcr, 6).alias("zcr"))


@register("voice_activity", f"""WITH {_QUIET}, {_frames_cte(512, 256)}, energy AS ({_ENERGY_SQL}), {_CROSSINGS},
level AS (SELECT clip_id, least(1.0, sqrt(avg(amp * amp)) / 0.1) AS rms_capped FROM px_samples GROUP BY clip_id),
parts AS (SELECT l.clip_id, c.n_samples, l.rms_capped, coalesce(e.frame_energy, 0.0) AS frame_energy,
                 least(1.0, c.crossings / (c.n_samples / 2.0)) AS zcr
          FROM level l JOIN crossings c ON c.clip_id = l.clip_id LEFT JOIN energy e ON e.clip_id = l.clip_id),
scored AS (SELECT *, rms_capped * 0.5 + frame_energy * 0.3 + zcr * 0.2 AS raw FROM parts)
SELECT clip_id, n_samples, round(rms_capped, 6) AS rms_capped, round(frame_energy, 6) AS frame_energy,
       round(zcr, 6) AS zcr, round(CASE WHEN raw < 0.02 THEN 0.0 ELSE least(1.0, raw) END, 6) AS score,
       raw >= 0.02 AS is_speech FROM scored""")
def voice_activity(spark, sf):
    return rounded(signal.voice_activity(_quiet(spark, sf)), "rms_capped", "frame_energy", "zcr", "score")


@register("energy_confidence", """WITH leveled AS (
  SELECT unnest(['all', l_returnflag, l_returnflag || l_linenumber, l_shipmode_key]) AS clip_id, amp FROM (
    SELECT l_returnflag, CAST(l_linenumber AS VARCHAR) AS l_linenumber, 's' || l_suppkey AS l_shipmode_key,
           (l_quantity - 25.5) / 25.5 * 0.1 AS amp FROM lineitem)),
stats AS (SELECT clip_id, count(*) AS n_samples, sqrt(avg(amp * amp)) AS rms FROM leveled GROUP BY clip_id)
SELECT clip_id, n_samples, round(CASE WHEN n_samples < 1600 THEN 0.3 ELSE greatest(0.1, least(1.0,
  least(1.0, rms / 0.1) * CASE WHEN n_samples / 8000.0 < 0.5 THEN 0.7 WHEN n_samples / 8000.0 > 5.0 THEN 0.95
                          ELSE 1.0 END)) END, 6) AS confidence FROM stats""")
def energy_confidence(spark, sf):
    flag, line = F.col("l_returnflag"), F.col("l_linenumber").cast("string")
    clips = proxies.table(spark, sf, "lineitem").select(
        F.explode(F.array(F.lit("all"), flag, F.concat(flag, line),
                          F.concat(F.lit("s"), F.col("l_suppkey").cast("string")))).alias("clip_id"),
        ((F.col("l_quantity") - 25.5) / 25.5 * 0.1).alias("amp"),
    )
    return rounded(signal.energy_confidence(clips, rate=8000), "confidence")


def _power_cte(win, hop, n_fft):
    return f"""{_frames_cte(win, hop)},
windowed AS (SELECT clip_id, frame, pos, amp * 0.5 * (1 - cos(2 * pi() * pos / ({win} - 1))) AS x FROM framed),
power AS (SELECT clip_id, frame, CAST(k AS INTEGER) AS bin,
                 sum(x * cos(2 * pi() * ((k * pos) % {n_fft}) / {n_fft})) ** 2
               + sum(x * sin(2 * pi() * ((k * pos) % {n_fft}) / {n_fft})) ** 2 AS val
          FROM windowed, range({n_fft // 2 + 1}) r(k) GROUP BY clip_id, frame, k)"""


def _bank_cte(n_fft, n_mels):
    top = "2595 * log10(1 + 8000.0 / 700)"
    return f"""edges AS (SELECT i, CAST(floor(({n_fft} + 1) * (700 * (pow(10, (i * {top} / ({n_mels} + 1)) / 2595) - 1)) / 16000)
                           AS INTEGER) AS e FROM range({n_mels} + 2) r(i)),
bank AS (SELECT CAST(a.i AS INTEGER) AS mel, CAST(k AS INTEGER) AS bin,
                CASE WHEN k >= a.e AND k < b.e THEN (k - a.e) / CAST(b.e - a.e AS DOUBLE)
                     WHEN k >= b.e AND k < c.e THEN (c.e - k) / CAST(c.e - b.e AS DOUBLE) ELSE 0 END AS weight
         FROM edges a JOIN edges b ON b.i = a.i + 1 JOIN edges c ON c.i = a.i + 2, range({n_fft // 2 + 1}) r(k)),
mels AS (SELECT p.clip_id, p.frame, b.mel, sum(p.val * b.weight) AS val
         FROM power p JOIN bank b ON b.bin = p.bin GROUP BY p.clip_id, p.frame, b.mel),
logmels AS (SELECT clip_id, frame, mel, ln(greatest(val, 1e-10)) AS val FROM mels)"""


_POWER = _power_cte(SMALL["win"], SMALL["hop"], SMALL["n_fft"])
_LOGMEL = f"WITH {SAMPLES}, {_POWER}, {_bank_cte(SMALL['n_fft'], SMALL_MELS)}"


def _packed(spark, sf):
    return signal.pack_chunks(proxies.samples(spark, sf), SMALL["win"], SMALL["hop"], frames=8)


def _power_rows(spark, sf):
    return spectrum.spectrum_rows(spectrum.power_spectrum(_packed(spark, sf), **SMALL))


def _mel_rows(spark, sf):
    fused = spectrum.log_mel(_packed(spark, sf), **SMALL, n_mels=SMALL_MELS)
    return spectrum.spectrum_rows(fused, "mel", "mel")


@register("power_spectrum", f"""WITH {SAMPLES}, {_POWER}
SELECT clip_id, frame, bin, round(val, 4) AS val FROM power""")
def power_spectrum(spark, sf):
    return rounded(_power_rows(spark, sf), "val", digits=4)


@register("mel_project", f"{_LOGMEL} SELECT clip_id, frame, mel, round(val, 4) AS val FROM mels")
def mel_project(spark, sf):
    bank = spectrum.mel_bank_table(spark, n_fft=SMALL["n_fft"], n_mels=SMALL_MELS)
    return rounded(spectrum.mel_project(_power_rows(spark, sf), bank, SMALL_MELS), "val", digits=4)


@register("log_floor", f"""{_LOGMEL} SELECT clip_id, frame, bin, round(ln(greatest(val - 0.5, 1e-10)), 4) AS val FROM power""")
def log_floor(spark, sf):
    shifted = _power_rows(spark, sf).withColumn("val", F.col("val") - 0.5)
    return rounded(spectrum.log_floor(shifted), "val", digits=4)


@register("log_mel", f"{_LOGMEL} SELECT clip_id, frame, mel, round(val, 4) AS val FROM logmels")
def log_mel(spark, sf):
    return rounded(_mel_rows(spark, sf), "val", digits=4)


_NORMALIZED = f"""{_LOGMEL}, stats AS (SELECT clip_id, mel, avg(val) AS m, stddev_pop(val) AS s FROM logmels GROUP BY clip_id, mel),
normed AS (SELECT l.clip_id, l.frame, l.mel, (l.val - s.m) / (s.s + 1e-5) AS val
           FROM logmels l JOIN stats s ON s.clip_id = l.clip_id AND s.mel = l.mel)"""


@register("normalize_per_feature", f"{_NORMALIZED} SELECT clip_id, frame, mel, round(val, 4) + 0.0 AS val FROM normed")
def normalize_per_feature(spark, sf, **blocks):
    return rounded(spectrum.normalize_per_feature(_mel_rows(spark, sf), **blocks), "val", digits=4).withColumn(
        "val", F.col("val") + F.lit(0.0))


_PADDED = f"""{_LOGMEL}, ends AS (SELECT clip_id, max(frame) + 1 AS n FROM logmels GROUP BY clip_id),
padded AS (SELECT clip_id, frame, mel, val FROM logmels UNION ALL
           SELECT clip_id, f AS frame, CAST(m AS INTEGER) AS mel, 0.0 AS val
           FROM ends, LATERAL (SELECT unnest(range(n, (n + 7) // 8 * 8)) AS f), range({SMALL_MELS}) r(m))"""


@register("pad_frames", f"{_PADDED} SELECT clip_id, frame, mel, round(val, 4) AS val FROM padded")
def pad_frames(spark, sf):
    return rounded(spectrum.pad_frames(_mel_rows(spark, sf)), "val", digits=4)


def _tensor_sql(order):
    return f"""{_PADDED}, placed AS (SELECT clip_id, val, row_number() OVER (PARTITION BY clip_id ORDER BY {order}) AS p FROM padded)
SELECT clip_id, count(*) // {SMALL_MELS} AS n_frames, {SMALL_MELS} AS n_mels, count(*) AS n_values,
       round(sum(p * val), 2) AS checksum FROM placed GROUP BY clip_id"""


def _tensor(spark, sf, layout):
    tensor = spectrum.to_tensor(spectrum.pad_frames(_mel_rows(spark, sf)), layout)
    weighted = F.aggregate(
        F.transform("tensor", lambda v, i: v * (i + 1)), F.lit(0.0), lambda acc, v: acc + v
    )
    return tensor.select("clip_id", "n_frames", "n_mels", F.size("tensor").cast("long").alias("n_values"),
                         F.round(weighted, 2).alias("checksum"))


@register("to_tensor_mel_major", _tensor_sql("mel, frame"))
def to_tensor_mel_major(spark, sf):
    return _tensor(spark, sf, "mel_major")


@register("to_tensor_time_major", _tensor_sql("frame, mel"))
def to_tensor_time_major(spark, sf):
    return _tensor(spark, sf, "time_major")


# Lengths for plans and gates: order totals as sample counts (up to minutes of audio at 16 kHz).
_LENGTHS = "lengths AS (SELECT o_orderkey AS clip_id, CAST(floor(o_totalprice * 10) AS BIGINT) AS n_samples FROM orders)"
_PLAN = f"""{_LENGTHS}, counted AS (SELECT clip_id, n_samples AS n,
  CASE WHEN n_samples <= 800000 THEN 1 ELSE (n_samples - 800000 + 767999) // 768000 + 1 END AS k
  FROM lengths WHERE n_samples > 0),
plan AS (SELECT clip_id, CAST(i AS INTEGER) AS chunk_idx, i * 768000 AS start_frame, least(i * 768000 + 800000, n) AS end_frame,
         i * 768000 AS overlap_start_frame, n AS clip_frames FROM counted, LATERAL (SELECT unnest(range(k)) AS i))"""


def _lengths(spark, sf):
    return proxies.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("clip_id"), F.floor(F.col("o_totalprice") * 10).cast("long").alias("n_samples")
    )


@register("plan_chunks", f"WITH {_PLAN} SELECT * FROM plan")
def plan_chunks(spark, sf):
    return chunks.plan_chunks(_lengths(spark, sf))


@register("model_chunks", f"""WITH {_PLAN} SELECT * FROM plan WHERE clip_frames > 960000
UNION ALL SELECT clip_id, 0, 0, n_samples, 0, n_samples FROM lengths WHERE n_samples BETWEEN 1 AND 960000""")
def model_chunks(spark, sf):
    return chunks.model_chunks(_lengths(spark, sf))


@register("audit_chunk_coverage", f"""WITH {_PLAN}, linked AS (SELECT *,
  lag(end_frame) OVER (PARTITION BY clip_id ORDER BY chunk_idx) AS prev_end,
  lag(start_frame) OVER (PARTITION BY clip_id ORDER BY chunk_idx) AS prev_start FROM plan WHERE clip_id % 7 <> 0 OR chunk_idx <> 1)
SELECT clip_id, count(*) AS chunks, count(*) FILTER (WHERE prev_end < start_frame) AS gaps,
  count(*) FILTER (WHERE start_frame <= prev_start) AS order_errors, min(start_frame) = 0 AS starts_at_zero,
  max(end_frame) = max(clip_frames) AS covers_end, min(prev_end - start_frame) AS min_overlap,
  max(prev_end - start_frame) AS max_overlap FROM linked GROUP BY clip_id""")
def audit_chunk_coverage(spark, sf, **blocks):
    plan = chunks.plan_chunks(_lengths(spark, sf))
    return chunks.audit_chunk_coverage(plan.filter((F.col("clip_id") % 7 != 0) | (F.col("chunk_idx") != 1)), **blocks)


@register("length_gate", """WITH lens AS (SELECT o_orderkey AS clip_id,
  CAST(CASE WHEN o_orderkey % 3 = 0 THEN floor(o_totalprice / 300) ELSE floor(o_totalprice * 10) END AS BIGINT) AS n_samples FROM orders),
framed AS (SELECT *, CASE WHEN n_samples >= 400 THEN (n_samples - 400) // 160 + 1 ELSE 0 END AS frames FROM lens)
SELECT clip_id, n_samples, frames, (frames + 7) // 8 * 8 AS padded_frames,
  CASE WHEN frames = 0 THEN 'empty' WHEN frames < 5 THEN 'too_short' WHEN frames > 6000 THEN 'too_long' ELSE 'ok' END AS length_class,
  CASE WHEN frames = 0 THEN '' WHEN frames < 5 THEN '[Audio too short for transcription]'
       WHEN frames > 6000 THEN '[Audio too long for transcription (max 6000 frames).]' END AS gate_text FROM framed""")
def length_gate(spark, sf):
    lens = proxies.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("clip_id"),
        F.when(F.col("o_orderkey") % 3 == 0, F.floor(F.col("o_totalprice") / 300))
        .otherwise(F.floor(F.col("o_totalprice") * 10)).cast("long").alias("n_samples"),
    )
    return chunks.length_gate(lens)


_STUB = ", ".join("'" + t + "'" for t in transcribe.STUB_REPLIES)


@register("transcribe_stub", f"""WITH {_PLAN}
SELECT clip_id, chunk_idx, CASE WHEN (end_frame - start_frame) / 16000.0 < 0.5 THEN ''
  ELSE [{_STUB}][CAST(floor((end_frame - start_frame) / 16000.0 * 10) AS INTEGER) % 5 + 1] END AS text FROM plan""")
def transcribe_stub(spark, sf):
    plan = chunks.plan_chunks(_lengths(spark, sf)).withColumn("n_samples", F.col("end_frame") - F.col("start_frame"))
    return transcribe.stub_transcribe(plan).select("clip_id", "chunk_idx", "text")


@register("transcribe_model", """
SELECT vec_id AS clip_id, CASE WHEN embedding[1] < 0 THEN '[Transcription error: negative start]'
  ELSE CAST(list_count(list_filter(embedding, lambda x: x > 0)) AS VARCHAR) || ' positive' END AS text,
  embedding[1] < 0 AS failed FROM embeddings""")
def transcribe_model(spark, sf):
    def load():
        def model(values):
            if values[0] < 0:
                raise ValueError("negative start")
            return f"{int((values > 0).sum())} positive"

        return model

    return transcribe.transcribe(proxies.vectors(spark, sf), load).select("clip_id", "text", "failed")


@register("transcribe_batched", """
SELECT vec_id AS clip_id, CASE WHEN embedding[1] < 0 THEN '[Transcription error: negative start]'
  ELSE CAST(list_count(list_filter(embedding, lambda x: x > 0)) AS VARCHAR) || ' positive' END AS text, embedding[1] < 0 AS failed,
  CASE WHEN embedding[1] < 0 THEN 0.0 WHEN vec_id % 2 = 0 THEN 0.3 ELSE round(CAST(greatest(0, embedding[2]) AS DOUBLE), 5) END AS confidence FROM embeddings""")
def transcribe_batched(spark, sf):
    """Batches of eight vectors; a batch with a bad vector fails and is called one by one. Every second answer has no confidence."""
    class Model:
        def __call__(self, values):
            if values[0] < 0:
                raise ValueError("negative start")
            return self.answer(values)

        def batch(self, padded, lengths):
            if (padded[:, 0] < 0).any():
                raise ValueError("a bad chunk among them")
            return [self.answer(row[:n]) for row, n in zip(padded, lengths)]

        @staticmethod
        def answer(values):
            text = f"{int((values[:64] > 0).sum())} positive"
            return text if values[64] == 0 else (text, max(0.0, float(values[1])))

    # A last sample tells the model whether to answer with a confidence.
    vectors = proxies.vectors(spark, sf).withColumn("samples", F.concat("samples", F.array((F.col("clip_id") % 2).cast("float"))))
    out = transcribe.transcribe(vectors, Model, batch_samples=8 * 65)
    return out.select("clip_id", "text", "failed", F.round("confidence", 5).alias("confidence"))
