import uuid
import wave

import pytest
from pyspark.sql import functions as F

from rostire.operators import audio, cli, corpus, metrics
from rostire.sources import readers as R
from rostire.sources import sinks as K


def tone(path, seconds, rate=8000):
    path.parent.mkdir(parents=True, exist_ok=True)
    with wave.open(str(path), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(b"\x01\x00" * int(seconds * rate))


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_ljspeech(spark, tmp_path):
    (tmp_path / "metadata.csv").write_text("a|Text | one\n\n|no id\nb|Two\n", encoding="utf-8")
    tone(tmp_path / "wavs/a.WAV", 0.1)
    got = R.ljspeech(spark, str(tmp_path / "metadata.csv"), speaker="m", root=str(tmp_path))
    assert rows(got, "rel_wav", "text", "speaker") == [("wavs/a.WAV", "Text | one", "m"), ("wavs/b.wav", "Two", "m")]


def test_swara(spark, tmp_path):
    tone(tmp_path / "SPK/u1.wav", 0.1)
    tone(tmp_path / "SPK/u2.wav", 0.1)
    tone(tmp_path / "SPK/u3.wav", 0.1)
    (tmp_path / "SPK/u1.txt").write_text("Unu", encoding="utf-8")
    (tmp_path / "SPK/u2.lab").write_text("Doi", encoding="utf-8")
    (tmp_path / "all.txt").write_text("u3|Trei\nu1|alt", encoding="utf-8")
    assert rows(R.swara(spark, str(tmp_path)), "rel_wav", "text", "speaker") == [("SPK/u1.wav", "Unu", "spk"), ("SPK/u2.wav", "Doi", "spk"), ("SPK/u3.wav", "Trei", "spk")]
    (tmp_path / "SWARA_ALL.csv").write_text("x/BAS_01.wav|Text\nrnd.wav|Alt\n", encoding="utf-8")
    assert rows(R.swara(spark, str(tmp_path)), "rel_wav", "speaker") == [("wavs/BAS_01.wav", "bas"), ("wavs/rnd.wav", "swara")]


def test_common_voice(spark, tmp_path):
    (tmp_path / "v.tsv").write_text("client_id\tpath\tsentence\nabcdefghijklmnop\ta.mp3\tDa\n\tb.mp3\tNu\nx\tc.mp3\t\n", encoding="utf-8")
    assert rows(R.common_voice(spark, str(tmp_path / "v.tsv")), "rel_wav", "speaker") == [("clips/a.mp3", "cv_abcdefghijkl"), ("clips/b.mp3", "cv_unknown")]


def test_policies(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"id": "1", "text": "a"}\n{bad\n', encoding="utf-8")
    read = lambda p: R.read_documents(spark, str(tmp_path / "d.jsonl"), text="text", id_col="id", policy=p)
    assert read("skip").count() == 1
    assert read("keep").where("_corrupt_record IS NOT NULL").cache().count() == 1
    with pytest.raises(Exception):
        read("fail").collect()


def test_manifest_and_folder(spark, tmp_path):
    tone(tmp_path / "in/a.wav", 1.0)
    tone(tmp_path / "in/b.wav", 3.0)
    df = spark.createDataFrame([("a.wav", "pa", "s", None), ("b.wav", "pb", "s", "sad")], "audio_file string, phonemes string, speaker string, emotion string")
    K.write_manifest(df, str(tmp_path / "man"))
    back = R.manifest_fields(spark.read.text(str(tmp_path / "man")), 3)
    assert rows(back.fillna(""), "audio_file", "phonemes", "emotion") == [("a.wav", "pa", ""), ("b.wav", "pb", "sad")]
    done = K.write_training_folder({"m": df}, str(tmp_path / "in"), str(tmp_path / "out"), max_seconds=2.0)
    assert rows(done, "audio_file", "text") == [("wavs/m__a.wav", "pa")]
    assert (tmp_path / "out/wavs/m__a.wav").exists()


def test_evaluation_json(spark, tmp_path):
    df = spark.createDataFrame([("1", "t", [1])], "id string, text string, x array<int>")
    K.write_json_lines(df, str(tmp_path / "o"))
    assert R.read_jsonl(spark, str(tmp_path / "o")).first()["text"] == "t"


def test_input_text(spark, tmp_path):
    with pytest.raises(ValueError):
        R.read_input_text(spark, text="a", stdin=True)
    (tmp_path / "a.txt").write_text("Ora 9:00.", encoding="utf-8")
    assert cli.main(["--input-file", str(tmp_path / "a.txt"), "--include", "normalized", "--output-file", str(tmp_path / "o.json")], spark) == 0
    assert "nouă fix" in (tmp_path / "o.json").read_text(encoding="utf-8")
    assert cli.main(["--text", "a", "--include", "nothing"], spark) == 2


def test_corpus_ranks(spark):
    df = spark.range(103).select(F.col("id"), (F.col("id") % 3).alias("g"))
    got = {(r["id"], r["rn"], r["total"]) for r in corpus.numbered(df, ["id"]).collect()}
    assert got == {(i, i + 1, 103) for i in range(103)}
    by = corpus.numbered(df, ["id"], ["g"]).collect()
    for g in range(3):
        own = sorted((r["id"], r["rn"]) for r in by if r["g"] == g)
        assert [n for _, n in own] == list(range(1, len(own) + 1))
    assert sorted(r["id"] for r in corpus.evenly_spaced(df.select("id"), ["id"], 10).collect()) == [i * 103 // 10 for i in range(10)]
    with pytest.raises(KeyError):
        corpus.lookup_by_text(spark.createDataFrame([("a",)], "t string"), "t", ["b"])
    assert metrics.adopt(0.5, 0.4, 0.4)[0] and not metrics.adopt(0.5, 0.49, 0.4)[0] and not metrics.adopt(0.5, 0.4, 0.6)[0]
    assert spark.range(0).select(F.col("id").cast("string").alias("text")).transform(lambda d: corpus.deduplicated(d, "text", ["text"])).count() == 0


def test_audio(spark):
    import numpy as np

    rate = 8000
    t = np.arange(rate) / rate
    x = np.concatenate([np.zeros(2000), 0.3 * np.sin(2 * np.pi * 440 * t) + 0.2, np.zeros(2000)]).astype(np.float32)
    y = audio.high_pass(x, rate)
    plain = x.astype(np.float64)
    for b, a in audio.biquads(60.0, rate):  # the sections, sample by sample
        out, z1, z2 = [], 0.0, 0.0
        for v in plain:
            o = b[0] * v + z1
            z1, z2 = b[1] * v - a[0] * o + z2, b[2] * v - a[1] * o
            out.append(o)
        plain = np.array(out)
    assert np.allclose(y, plain, atol=1e-6)
    assert abs(float(y[4000:8000].mean())) < 0.02
    assert len(audio.trim_silence(x, rate)) < len(x)
    assert abs(20 * np.log10(np.sqrt(np.mean(audio.loudness(x).astype(float) ** 2))) + 23) < 0.1
    assert np.abs(audio.peak_limit(x * 9)).max() <= 0.9701
    assert np.array_equal(audio.finish(x, rate), audio.finish(x, rate))
    df = spark.createDataFrame([(x.tolist(), rate), (None, rate), ([], rate)], "x array<float>, r int")
    got = [r["y"] for r in df.select(audio.finished(F.col("x"), F.col("r")).alias("y")).collect()]
    assert got[1] is None and got[2] == [] and len(got[0]) < len(x)


def test_stream(spark, tmp_path):
    from rostire.streaming.documents import annotate_stream, write_parquet_stream

    spark.createDataFrame([("1", "Ora 9:00.")], "id string, text string").write.parquet(str(tmp_path / "in"))
    out = annotate_stream(spark.readStream.schema("id string, text string").parquet(str(tmp_path / "in")), "normalize_only", "text", "id").select("id", "normalized_text")
    write_parquet_stream(out, str(tmp_path / "out"), uuid.uuid4().hex).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first()["normalized_text"] == "Ora nouă fix."


def test_models_see_each_distinct_value_once(spark, tmp_path):
    from rostire.operators import models

    seen = spark.sparkContext.accumulator(0)
    loads = spark.sparkContext.accumulator(0)

    def load():
        loads.add(1)

        def model(values):
            seen.add(len(values))
            return [v.upper() for v in values]

        return model

    rows = [(k, ["unu", "doi", "trei"][k % 3]) for k in range(300)] + [(300, None), (301, " ")]
    df = spark.createDataFrame(rows, "k int, t string")
    cache = str(tmp_path / "cache")
    got = {r["k"]: r["u"] for r in models.over_distinct(df, "t", "u", "upper", load, "string", cache).collect()}
    assert got == {k: t.upper() if t and t.strip() else None for k, t in rows} and seen.value == 3 and loads.value <= 3
    more = df.union(spark.createDataFrame([(400, "patru")], "k int, t string"))
    assert models.over_distinct(more, "t", "u", "upper", load, "string", cache).where("u = 'PATRU'").count() == 1
    assert seen.value == 4
    assert models.over_distinct(df.limit(0), "t", "u", "upper", load, "string").count() == 0


def test_phonetics_and_members(spark):
    from rostire.operators import models

    df = spark.createDataFrame([("Plata TVA, azi!",), (None,), ("",)], "t string")
    say = lambda **kw: [r["p"] for r in df.select(models.phonetics_only(F.col("t"), **kw).alias("p")).collect()]
    assert say() == ["plata tˈe vˈe ˈa , azi !", None, ""]
    assert say(load=lambda: lambda ws: ["" if w == "azi" else f"/{w}/" for w in ws], overrides={"plata": "x"}, name="n1") == ["x /TVA/ , azi !", None, ""]


def test_shared_folder_is_never_local_on_a_cluster(monkeypatch):
    from rostire import runtime

    class Far:
        class conf:
            get = staticmethod(lambda k, d=None: None)

        class sparkContext:
            master = "spark://far:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        runtime.shared_dir(Far)


def test_long_documents_are_cut_in_linear_time(spark):
    from rostire.functions import text as X
    from rostire.operators import layers

    big = "Ana are mere și pere azi. " * 40_000  # a megabyte
    df = spark.createDataFrame([(big,), ("a" * 1_000_000,), (None,), ("",)], "t string")
    got = df.select(F.size(X.segment(F.col("t"))).alias("s"), F.size(layers.rule_tokens(F.col("t"))).alias("k"), F.size(X.pause_locations(F.col("t"))).alias("p")).collect()
    assert [tuple(r) for r in got[:2]] == [(40_000, 280_000, 40_000), (1, 1, 0)]


def test_joined_and_resampled():
    import numpy as np

    a, b = np.ones(10, dtype=np.float32), np.full(6, 3, dtype=np.float32)
    assert audio.joined([a, b], 1000, [5]).tolist() == [1.0] * 10 + [0.0] * 5 + [3.0] * 6
    faded = audio.joined([a, b], 1000, None, 4)
    assert len(faded) == 12 and np.all(np.diff(faded[5:]) >= 0) and audio.joined([], 1000).size == 0
    t = np.arange(800) / 8000
    x = np.sin(2 * np.pi * 100 * t).astype(np.float32)
    y = audio.resampled(x, 8000, 16000)
    assert len(y) == 1600 and np.abs(y[::2] - x).max() < 1e-3 and len(audio.resampled(x, 8000, 4000)) == 400


def test_loudness_follows_the_standard():
    import numpy as np

    rate = 48000
    t = np.arange(4 * rate) / rate
    x = np.sin(2 * np.pi * 997 * t).astype(np.float32)
    assert abs(audio.lufs(x, rate) + 3.01) < 0.1 and abs(audio.lufs(x / 10, rate) + 23.01) < 0.1
    low = np.sin(2 * np.pi * 20 * t).astype(np.float32)
    assert audio.lufs(low, rate) < -9 and audio.lufs(x[:100], rate) == -np.inf and audio.lufs(np.zeros(rate), rate) == -np.inf
    gated = np.concatenate([x, np.zeros(8 * rate, dtype=np.float32)])
    assert abs(audio.lufs(gated, rate) + 3.01) < 0.4
    assert abs(audio.lufs(audio.loudness(x, -20.0, rate), rate) + 20) < 0.01
