from pyspark.sql import functions as F

from foldline.functions import geo, media, names, paths, text, times


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_names_of_files(spark):
    stems = {"sunset": 1, "Goa_trip": 1, "Bali2024": 1, "20230520_wedding": 1, "a": 1, "IMG_3162": 0, "_MG_1721": 0, "PXL_20230520": 0, "IMG_20240501_143000_00_001": 0, "12345": 0, "___": 0, "": 0, "IMG_1\n": 1}
    got = one(spark, [(s,) for s in stems], "s string", "s", text.has_meaningful_name(F.col("s")))
    assert {s: int(b) for s, b in got} == stems
    copies = {"IMG_3162 (1)": 1, "sunset - Copy": 1, "document copy 3": 1, "presentation Copy (1)": 1, "copy-of-file": 0, "(1) at start": 0}
    assert {s: int(b) for s, b in one(spark, [(s,) for s in copies], "s string", "s", F.col("s").rlike(text.COPY_STEM))} == copies
    dates = {"20230520_x.jpg": 1, "2023-05-20_x.jpg": 1, "2023_05_20_x.jpg": 1, "2023-05-20.jpg": 0, "20230520.jpg": 0}
    assert {s: int(b) for s, b in one(spark, [(s,) for s in dates], "s string", "s", F.col("s").rlike(text.DATE_NAME))} == dates
    dirs = {"DCIM": 1, "New Folder (2)": 1, "old backup 3": 1, "WhatsApp Images": 1, ".trashed-1": 1, "downloads_2": 1, "Goa Trip": 0, "backups": 0}
    assert {s: int(b) for s, b in one(spark, [(s,) for s in dirs], "s string", "s", text.is_generic_dir(F.col("s")))} == dirs
    parts = one(spark, [("a.tar.gz",), (".x",), ("plain",), ("IMG_E12.JPG",)], "s string", text.stem(F.col("s")), text.extension(F.col("s")), text.capture_stem(F.col("s")))
    assert parts == [("a.tar", ".gz", "a.tar"), ("", ".x", ""), ("plain", "", "plain"), ("IMG_E12", ".JPG", "IMG_12")]


def test_segments_and_devices(spark):
    want = {"Goa Trip 2024": "Goa-Trip-2024", "Springfield, Illinois": "Springfield-Illinois", "a/b\\c:d": "a-b-c-d", "a---b": "a-b", "  .leading-and-trailing._  ": "leading-and-trailing", "": "-", ",,,": "-"}
    assert dict(one(spark, [(s,) for s in want], "s string", "s", text.sanitize(F.col("s")))) == want
    cases = {"iphone 15 PRO": "iPhone 15 Pro", "new_delhi-cantt": "New_Delhi-Cantt", "": "", "éLAN": "Élan", "a  b": "A  B"}
    assert dict(one(spark, [(s,) for s in cases], "s string", "s", text.case_name(F.col("s")))) == cases
    rows = [("Canon", "Canon EOS R5", "Canon EOS R5"), ("Apple", "iPhone", "Apple iPhone"), ("", "X", "X"), (None, None, ""), ("Y", None, "Y")]
    assert all(a == b for a, b in one(spark, rows, "a string, b string, c string", "c", text.device_name(F.col("a"), F.col("b"))))
    assert dict(one(spark, [("Banjār",), ("São Paulo",), ("plain",)], "s string", "s", text.strip_accents(F.col("s")))) == {"Banjār": "Banjar", "São Paulo": "Sao Paulo", "plain": "plain"}
    assert one(spark, [("Ab",), ("",)], "s string", text.trigrams(F.col("s"))) == [([" ab", "ab "],), ([],)]
    assert [x[0] for x in one(spark, [(1023,), (1536,), (1280,), (5 << 30,)], "n long", text.human_bytes(F.col("n")))] == ["1023 B", "1.5 KiB", "1.2 KiB", "5.0 GiB"]


def test_times(spark):
    for s in ("+05:30", "-07:00", "Z"):
        assert one(spark, [("2024:06:03 14:00:00" + s,)], "s string", times.strip_offset(F.col("s"))) == [("2024:06:03 14:00:00",)]
    f = lambda x: None if x is None else x.isoformat()
    cases = {"2024:06:03 08:30:00": "2024-06-03T08:30:00", "2024:06:03 08:30:00.5": "2024-06-03T08:30:00.500000", "2024:06:03 14:00:00+05:30": "2024-06-03T08:30:00", "2024-06-03T08:30:00Z": "2024-06-03T08:30:00", "2024-06-03": "2024-06-03T00:00:00", "1969:12:31 00:00:00": None, "0000:00:00 00:00:00": None, "junk": None, "": None, "2024:13:01 00:00:00": None}
    assert {s: f(t) for s, t in one(spark, [(s,) for s in cases], "s string", "s", times.parse_time(F.col("s")))} == cases
    got = one(spark, [("2024:06:03 14:00:00+05:30",)], "s string", times.parse_wall(F.col("s")))
    assert f(got[0][0]) == "2024-06-03T14:00:00"
    spans = [("2024-01-02", "2024-01-02", "02"), ("2024-01-02", "2024-01-05", "02-05"), ("2024-01-30", "2024-02-03", "Jan_30-Feb_03"), ("2023-12-31", "2024-12-31", "Dec_31-Dec_31")]
    assert all(a == b for a, b in one(spark, spans, "a string, b string, c string", "c", times.span_label(F.col("a").cast("timestamp"), F.col("b").cast("timestamp"))))
    assert times.parse_day_range("03") == (3, 3) and times.parse_day_range("01_26") == (1, 26) and times.parse_day_range("Goa") is None and times.parse_day_range("32") is None


def test_places_and_media(spark):
    rows = [("31 deg 34' 5.84\" N", 31.568289), ("77 deg 22' 14.32\" W", -77.370644), ("", None), ("x", None), ("31 deg 34' 5.84\"", None)]
    for a, b in one(spark, rows, "s string, d double", F.round(geo.parse_dms(F.col("s")), 6), "d"):
        assert a == b
    lad = [("Shimla", "", "", 1, 1, 1, "Shimla"), ("Springfield", "Illinois", "United States", 14, 2, 13, "Springfield, Illinois"), ("Springfield", "Queensland", "Australia", 14, 2, 1, "Springfield, Australia"), ("Hyderabad", "Telangana", "India", 2, 2, 1, "Hyderabad, India"), ("Wadgaon", "Maharashtra", "India", 2, 1, 2, "Wadgaon, Maharashtra"), ("Nowhere", "", "", 2, 1, 2, "Nowhere")]
    c = F.col
    for a, b in one(spark, lad, "a string, b string, c string, d int, e int, f int, w string", names.disambiguate(c("a"), c("b"), c("c"), c("d"), c("e"), c("f"), F.lit(False)), "w"):
        assert a == b
    full = [("Singapore", "Singapore", "Singapore", "Singapore"), ("Nowhere", "", "Atlantis", "Nowhere, Atlantis"), ("Banjar", "Himachal Pradesh", "India", "Banjar, Himachal Pradesh, India")]
    assert all(a == b for a, b in one(spark, full, "a string, b string, c string, w string", names.full_name(c("a"), c("b"), c("c")), "w"))
    kinds = {"IMG_001.jpg": "IMAGE", "x.HEIC": "IMAGE", "c.mp4": "VIDEO", "r.cr2": "RAW", "e.aae": "SIDECAR", "readme.txt": "UNKNOWN", "._a.jpg": "UNKNOWN"}
    assert dict(one(spark, [(s,) for s in kinds], "s string", "s", media.media_type(F.col("s")))) == kinds
    docs = [('{"Description":"Screenshot"}', True, ""), ('{"SamsungCaptureInfo":"Screen recording","ImageWidth":12}', True, "12"), ('{"UserComment":"x","ImageWidth":1.5}', False, "1.5"), ("broken", False, ""), ('{"ImageWidth":null}', False, "")]
    for got, w, shot, want in one(spark, docs, "d string, s boolean, w string", media.is_screen_capture(F.col("d")), media.tag(F.col("d"), "ImageWidth"), "s", "w"):
        assert (got, w) == (shot, want)
    assert one(spark, [("a/b/c",)], "s string", paths.prefixes(F.col("s"))) == [(["a", "a/b", "a/b/c"],)]
    assert [x[0] for x in one(spark, [("/a",), ("/a/b",), ("/ab",), ("/",)], "s string", paths.under(F.col("s"), "/a/"))] == [True, True, False, False]
    assert one(spark, [(1.005,), (-0.015,)], "x double", geo.cell_key(F.col("x"))) == [(100,), (-2,)]
