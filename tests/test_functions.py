import math
import random

from pyspark.sql import functions as F

from sparkaudit.functions import episodes as E
from sparkaudit.functions import media as M
from sparkaudit.functions import numeric as N
from sparkaudit.functions import text as X
from sparkaudit.functions.symbols import symbols_of, words_of


def one(spark, values, kind, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.select(make(F.col("x")).alias("y"), "i").orderBy("i").select("y").collect()]


def test_fixed_rounds_like_c(spark):
    rng = random.Random(4)
    values = [0.0, 2.25, 0.15, 2.675, 1.005, 0.5, 1.5, 2.5, -2.25, -0.04, 1e15, 99999.995, 1e-9]
    values += [rng.random() * 10 ** rng.randint(-3, 9) for _ in range(3000)]
    values += [rng.randint(0, 10**7) / 1000 for _ in range(3000)] + [rng.randint(0, 10**5) / 16 for _ in range(1000)]
    for digits in range(5):
        assert one(spark, values, "double", lambda x: X.fixed(x, digits)) == [f"{v:.{digits}f}" for v in values]


def test_sizes_rates_and_durations(spark):
    assert one(spark, [512, 1536, 2 * 1024**2, 3 * 1024**3], "bigint", X.fmt_size) == ["0 KB", "2 KB", "2.0 MB", "3.00 GB"]
    assert one(spark, [0.0, 999.0, 1500.0, 2250000.0], "double", X.fmt_bitrate) == ["N/A", "999 bps", "2 Kbps", "2.2 Mbps"]
    assert one(spark, [math.inf, 0.5], "double", X.fmt_efficiency) == ["N/A", "0.5000"]
    assert one(spark, [None, 95.125], "double", X.fmt_vmaf) == ["N/A", "95.12"]
    assert one(spark, [0.0, 59.9, 3661.5, 360000.0], "double", X.duration_hms) == ["unknown", "0:00:59", "1:01:01", "100:00:00"]
    assert one(spark, ["abcdef", "abc"], "string", lambda x: X.truncate_text(x, 4)) == ["abc…", "abc"]
    assert one(spark, ["abcdef", "a"], "string", lambda x: X.pad_left(x, 3)) == ["abcdef", "  a"]


def test_probe_fields(spark):
    assert one(spark, ["24000/1001", "0/0", "25", "a/b", "30/1/1", None], "string", M.parse_rate) == [
        24000 / 1001, 0.0, 0.0, 0.0, 0.0, 0.0]
    names = ["a.mkv", "a.MP4", "._a.mkv", ".mkv", "a.txt", "_b.dvr-ms", "a.mkv.part"]
    assert one(spark, names, "string", M.is_media_name) == [True, True, False, False, False, True, False]
    assert len(M.CODEC_FACTORS) == 37 and len(M.VIDEO_EXTENSIONS) == 39


def test_names_of_every_shape(spark):
    cases = {
        "S01E01.mkv": [(1, 1)],
        "S01E01-E03.mkv": [(1, 1), (1, 2), (1, 3)],
        "S01E01E02.mkv": [(1, 1), (1, 2)],
        "1x02.mkv": [(1, 2)],
        "Show 101.mkv": [(1, 1)],
        "Show.S00E01.720p.mkv": [(7, 20)],
        "S100E05.305.mkv": [],
        "S01E01E02E03.mkv": [(1, 1), (1, 2)],
        "S01E01E03.mkv": [(1, 1), (1, 2), (1, 3)],
        "S01E03-E01.mkv": [(1, 3)],
        "nothing.mkv": [],
        "S01E05–E07.mkv": [(1, 5), (1, 6), (1, 7)],
        "s00000000000000001e2.mkv": [(1, 2)],
        "S99999999999E1.mkv": [],
    }
    got = one(spark, list(cases), "string", E.episodes_of)
    assert [[tuple(p) for p in ps] for ps in got] == list(cases.values())


def test_season_folders(spark):
    folders = ["Season 1", "Season_01", "S02", "s.3", "Extras 2", "12", " 7 ", "Specials", "misc"]
    assert one(spark, folders, "string", E.season_of) == [1, 1, 2, 3, 2, 12, 7, None, None]


def test_status_airing_labels(spark):
    assert one(spark, ['{"name":"Ended"}', "Running", '"Quoted"', None, "{}"], "string", E.status_text) == [
        "Ended", "Running", "Quoted", "Unknown", "Unknown"]
    assert one(spark, ["", "2020-01-01", "2020-01-02", None], "string", lambda a: E.is_aired(a, "2020-01-01")) == [
        False, True, False, False]
    assert one(spark, [5, 105], "int", lambda e: X.season_ep_label(F.lit(1), e)) == ["S01E05", "S01E105"]


def test_blending(spark):
    assert one(spark, [-1.0, 0.0, 0.5, 1.0, 9.0], "double", N.smoothstep) == [0.0, 0.0, 0.5, 1.0, 1.0]
    assert one(spark, [0.0, 0.575, 7.7], "double", N.depth_of)[0::2] == [1.0, 0.0]
    assert N.normalise_clamped(F.lit(1.0), 2, 2) is not None


def test_words_and_symbols(spark):
    assert one(spark, ["Hello, it's 2 b!"], "string", words_of) == [["Hello", "it's", "b"]]
    got = one(spark, ["hello", "queue", "shh", "Bye"], "string", lambda w: F.array_join(symbols_of(w), ""))
    assert got == ["2884", "4", "", "532"]


def test_season_numbers_of_any_length(spark):
    names = ["Season 1234567890", "Season 0000000000000000000012", "S2147483647", "Season 2147483648", "Season " + "9" * 40, "12345678901", "7"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = [r[0] for r in df.select(E.season_of(F.col("name"))).collect()]
    assert got == [1234567890, 12, 2147483647, None, None, None, 7]
