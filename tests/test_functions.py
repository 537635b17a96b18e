import random
import re
from difflib import SequenceMatcher

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assayline.functions import dates, html, patterns, predicates as p, similarity, text
from assayline.functions.html import page_text
from assayline.functions.similarity import jaro_winkler_of, sequence_ratio_of
from assayline.vocabulary import CONTEXT_PATTERNS, DIRECT_PATTERNS, GUARDED_PATTERNS
from tests.conftest import rows


def values(spark, items, *cols, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [tuple(r)[1:] for r in df.select("i", *cols).orderBy("i").collect()]


def test_blank_counts_spaces_but_not_tabs(spark):
    assert values(spark, [None, "", "  ", "\t", "x"], p.is_blank("v")) == [(True,), (True,), (True,), (False,), (False,)]


def test_null_does_not_count_as_wrong_constant(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "v string")
    assert df.agg(F.count_if(p.wrong_constant("v", "a"))).first()[0] == 1


def test_suspicious_label_has_a_length_test_and_row_has_none(spark):
    got = values(spark, ["-", "A ", "", "AB", None], p.suspicious_label("v"))
    assert [g[0] for g in got] == [True, True, True, False, None]


def test_lower_case_of_dotted_i_is_one_letter(spark):
    got = values(spark, ["İçtihat", "ISPARTA"], text.lower_tr(F.col("v")), F.length(text.lower_tr(F.col("v"))))
    assert got == [("içtihat", 7), ("isparta", 7)]


def test_numeric_key_ignores_blanks_and_padding(spark):
    got = values(spark, ["2006/0113", "2006 / 113", "E. 2006/113 K", "n/a", None],
                 text.key_year(F.col("v")), text.key_number(F.col("v")))
    assert got == [(2006, 113)] * 3 + [(None, None)] * 2


def test_canonical_name(spark):
    got = values(spark, [" 14.  Hukuk-Dairesi ", "İDARE"], text.canonical_name(F.col("v")))
    assert [g[0] for g in got] == ["14 hukuk dairesi", "idare"]


def python_normal(s):
    s = s.casefold().replace(" ", " ")
    s = re.sub(r"\s+", " ", s)
    return re.sub(r"[^0-9a-zçğıöşü /.:,-]+", "", s).strip()


def test_normal_form_equals_case_folding_in_python(spark):
    rng = random.Random(7)
    alphabet = "aAiIıİşŞğĞüÜöÖçÇßẞſﬁﬀŉǰẖẚKéè $&-./:,1 \t\n  \x1c\x85İ̇Σς"
    items = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    got = [g[0] for g in values(spark, items, text.normalize_text(F.col("v")))]
    assert got == [python_normal(s) for s in items]


def test_windows_cover_the_text(spark):
    rng = random.Random(4)
    sizes = (0, 1, 99, 100, 101, 1399, 1400, 1401, 1499, 1500, 1501, 2899, 2900, 2901, 4300, 9000)
    items = ["".join(rng.choice("ab ç\n\u2028😀") for _ in range(n)) for n in sizes] + [" " * 5, " " * 3000 + "x", None]
    got = [g[0] for g in values(spark, items, text.text_windows(F.col("v")))]

    def expected(s):
        starts = range(0, max(1, len(s) - 100), 1400)
        return [w for w in (s[k : k + 1500] for k in starts) if w.strip()]

    assert got == [expected(s or "") for s in items]


def test_pilot_windows_at_the_limit(spark):
    rng = random.Random(3)
    items = ["".join(rng.choice("ab c") for _ in range(n)) for n in (0, 1, 1500, 1501, 1510, 4000)] + [" " * 5, " " * 1501]
    got = [g[0] for g in values(spark, items, text.pilot_windows(F.col("v")))]

    def expected(s):
        if len(s) <= 1500:
            cut = [s]
        else:
            mid = max(0, len(s) // 2 - 750)
            cut = [s[:1500], s[mid:mid + 1500]]
        return [c for c in cut if c.strip()]

    assert got == [expected(s) for s in items]


def test_length_ratio_and_rates(spark):
    df = spark.createDataFrame([("", "", 0, 0), ("ab", "abc", 1, 4)], "a string, b string, x int, y int")
    got = df.select(text.length_ratio(F.col("a"), F.col("b")), text.rate(F.col("x"), F.col("y")),
                    text.ratio(F.col("x"), F.col("y"))).collect()
    assert [tuple(r) for r in got] == [(1.0, 0.0, None), (0.666667, 0.25, 0.25)]


def test_dates(spark):
    got = values(spark, ["2026-09-06T21:00:00.000+00:00", "2014-01-01T22:00:00.000+00:00"], dates.local_date(F.col("v")))
    assert [str(g[0]) for g in got] == ["2026-09-07", "2014-01-02"]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = values(spark, ["2026-09-06T21:00:00.000+00:00", "2026-09-06T20:59:00Z", "x"], dates.local_date(F.col("v")))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [str(g[0]) for g in got] == ["2026-09-07", "2026-09-06", "None"]
    got = values(spark, ["07.09.2026", "2026-09-07", None], dates.dotted_date(F.col("v")), dates.dotted_year(F.col("v")))
    assert [(str(a), b) for a, b in got] == [("2026-09-07", 2026), ("None", None), ("None", None)]


WORDS = ("sanık", "SANIK", "Şüpheli", "ŞÜPHELİ", "davacı", "DAVACI", "davacının", "mağdur", "MAĞDUR", "çocuk", "küçük",
         "reşit olmayan", "Ahmet", "Yılmaz", "ÇETİN", "mah.", "SOK.", "ikametgâh", "hiv", "HİV", "tr330006100519786457841326",
         "xTR330006100519786457841326", "a.b@c.com.tr", "@x", "0532 111 22 33", "05321112233", "+90 532 111 2233", "1",
         "T.C. Kimlik No: 12345678901", "tc 12345678901", "TÜRKİYE CUMHURİYETİ numarası 12345678901", "kart 4111 1111 1111 1111",
         "KREDİ KARTI: 4111-1111-1111-1111", "banka kartı", ":", "-", "\n", " ", "", "ı", "ſ", "K", ",", "[TCKN]")


def random_texts(n=1500, seed=11):
    rng = random.Random(seed)
    glue = (" ", "", "  ", "\n", ".", " - ")
    return ["".join(rng.choice(WORDS) + rng.choice(glue) for _ in range(rng.randint(0, 9))) for _ in range(n)]


def test_patterns_match_as_in_an_re2_engine(spark):
    texts = random_texts()
    all_patterns = {n: q for _, n, q in DIRECT_PATTERNS} | CONTEXT_PATTERNS
    con = duckdb.connect()
    want = {n: [con.execute("SELECT regexp_matches(?, ?)", [t, q]).fetchone()[0] for t in texts]
            for n, q in all_patterns.items()}
    t = F.col("v")
    plain = values(spark, texts, *[patterns.matches(t, q) for q in all_patterns.values()])
    assert {n: [g[k] for g in plain] for k, n in enumerate(all_patterns)} == want
    flags = patterns.direct_flags(t)
    guarded = values(spark, texts, *flags.values())
    assert [[g[k] for g in guarded] for k in range(5)] == [want[n] for _, n, _ in DIRECT_PATTERNS]
    context = values(spark, texts, *patterns.context_flags(t, patterns.needle_form(t)).values())
    assert [[g[k] for g in context] for k in range(6)] == [want[n] for n in CONTEXT_PATTERNS]
    assert all(0 < sum(w) < len(texts) for w in want.values())


def test_turkish_mode_finds_capitals_and_accented_edges(spark):
    t = F.col("v")
    flags = patterns.context_flags(t, patterns.needle_form(t, "turkish"), "turkish")
    got = values(spark, [" ŞÜPHELİ ", "DAVACI vekili", "davacının", "SANIK"], flags["party_role_label"])
    assert [g[0] for g in got] == [True, True, False, True]
    re2 = patterns.context_flags(t, patterns.needle_form(t))
    got = values(spark, [" şüpheli ", "davacı vekili", "davacının"], re2["party_role_label"])
    assert [g[0] for g in got] == [False, False, True]


def test_turkish_needles_never_lose_a_match(spark):
    t = F.col("v")
    texts = random_texts(seed=5)
    got = values(spark, texts, *patterns.context_flags(t, patterns.needle_form(t, "turkish"), "turkish").values(),
                 *[patterns.matches(t, q, "turkish") for q in CONTEXT_PATTERNS.values()])
    assert all(g[:6] == g[6:] for g in got)


def test_masking_as_in_an_re2_engine(spark):
    texts = random_texts(400, 23)
    con = duckdb.connect()

    def expected(s):
        for label, _, q in DIRECT_PATTERNS:
            s = con.execute("SELECT regexp_replace(?, ?, ?, 'g')", [s, q, f"[{label}]"]).fetchone()[0]
        return s

    got = values(spark, texts, patterns.mask_pii(F.col("v")))
    assert [g[0] for g in got] == [expected(s) for s in texts]


def test_masking_of_neighbours(spark):
    twice = "0532 111 22 33 0533 111 22 33"
    (plain, guarded), = values(spark, [twice], patterns.mask_pii(F.col("v")), patterns.mask_pii(F.col("v"), guarded=True))
    assert plain == "[TELEFON]0533 111 22 33"
    assert guarded == "[TELEFON] [TELEFON]"
    assert set(GUARDED_PATTERNS) == {"IBAN", "TELEFON"}


def test_jaro_winkler_vectors():
    for a, b, want in (("14 hukuk dairesi", "12 hukuk dairesi", 0.9625), ("9 hukuk dairesi", "1 hukuk dairesi", 0.9556),
                       ("6 ceza dairesi", "8 ceza dairesi", 0.9524), ("8 hukuk dairesi", "12 hukuk dairesi", 0.9361)):
        assert round(jaro_winkler_of(a, b), 4) == want
    rng = random.Random(2)
    con = duckdb.connect()
    for _ in range(400):
        a, b = ("".join(rng.choice("abcçı 12") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert jaro_winkler_of(a, b) == pytest.approx(con.execute("SELECT jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0])


@pytest.mark.parametrize("seed", range(4))
def test_sequence_ratio_equals_the_standard_library(seed):
    rng = random.Random(seed)
    for _ in range(25):
        a = "".join(rng.choice("abcd efş") for _ in range(rng.randint(0, 900)))
        b = list(a)
        for _ in range(rng.randint(0, 30)):
            if b:
                i = rng.randrange(len(b))
                b[i:i + rng.randint(0, 20)] = rng.choice(("", "x", "abc", "zz"))
        b = "".join(b)
        assert sequence_ratio_of(a, b) == SequenceMatcher(None, a, b, autojunk=False).ratio()


@pytest.mark.parametrize(("small", "hits"), [(0, 1), (16, 16), (1 << 12, 16), (1 << 12, 0)])
def test_listed_runs_give_the_blocks_of_the_standard_library(small, hits, monkeypatch):
    monkeypatch.setattr(similarity, "_SMALL", small)
    monkeypatch.setattr(similarity, "_HITS", hits)
    rng = random.Random(hits)
    for letters in ("ab", "abcdefgh ", "abcçğ\u4e00\U0001f600 x"):
        for _ in range(60):
            a = "".join(rng.choices(letters, k=rng.choice([0, 1, 30, 150]))) * rng.choice([1, 1, 3])
            b = list(a) if rng.random() < 0.7 else rng.choices(letters, k=len(a))
            for _ in range(rng.randint(0, 12)):
                k = rng.randint(0, len(b))
                b[k : k + rng.randint(0, 6)] = rng.choices(letters, k=rng.randint(0, 6))
            b = "".join(b)
            blocks = SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
            assert similarity.matching_chars(a, b) == sum(m.size for m in blocks)


def test_a_text_with_many_changes_needs_no_search_per_block(monkeypatch):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(3000)]
    a, b = " ".join(words), " ".join("karar" if k % 15 == 7 else w for k, w in enumerate(words))
    searches = []
    search = similarity._longest_match
    monkeypatch.setattr(similarity, "_longest_match", lambda *x: searches.append(1) or search(*x))
    assert 0.9 < sequence_ratio_of(a, b) < 1 and not searches


def test_sequence_ratio_takes_whole_long_texts():
    rng = random.Random(9)
    a = "".join(rng.choice("abcdefghij klmnop") for _ in range(60_000))
    b = a[:20_000] + "Z" * 50 + a[20_100:]
    assert sequence_ratio_of(a, b) == pytest.approx(2 * 59_900 / (60_000 + 59_950))


def test_html_text_keeps_script_bodies_and_resolves_entities():
    assert page_text("<p>a &amp; b</p><script>x<1</script><p>c</p>") == "a & b\nx<1\nc"
    assert page_text(None) is None
    assert page_text("") == ""


def test_rows_helper(spark):
    assert rows(spark.range(2)) == [(0,), (1,)]


@pytest.mark.parametrize("guarded", [False, True])
@pytest.mark.parametrize("mode", ["re2", "turkish"])
def test_masking_step_by_step_equals_masking_without_tests(spark, mode, guarded):
    rng = random.Random(6)
    parts = ["TR" + "1" * 24, "tr" + "2" * 24, "x", "TR" + "3" * 23, "a.b@c.de", "@", "0532 123 45 67", "+90 532-123-45-67", "05321234567", "TC kimlik no: 12345678901",
             "T.C. 12345678901", "kredi kartı 1234 5678 9012 3456", "kart", "1234567890123", "[TCKN]", "İ", " ", ",", "9", None]
    items = [None, ""] + ["".join(p for p in rng.choices(parts, k=rng.randint(1, 7)) if p) for _ in range(400)]
    v = plain = F.col("v")
    for label, _, pattern in DIRECT_PATTERNS:
        pattern = GUARDED_PATTERNS.get(label, pattern) if guarded else pattern
        plain = F.regexp_replace(plain, F.lit(patterns.portable(pattern, mode)), F.lit(f"[{label}]"))
    got = values(spark, items, patterns.mask_pii(v, mode, guarded), plain)
    assert all(a == b for a, b in got) and sum(a != i for (a, _), i in zip(got, items)) > 200


def test_a_text_without_signs_of_an_identifier_is_not_rewritten(spark):
    plan = spark.range(1).select(patterns.mask_pii(F.col("id").cast("string")).alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN") == plan.count("regexp_replace") == len(DIRECT_PATTERNS)


def test_pages_of_a_batch_are_read_a_few_at_a_time(monkeypatch):
    """A batch stays in Arrow's form: no more than a few pages are Python objects at once."""
    monkeypatch.setattr(html, "AT_ONCE", 3)
    pages = pa.array(["<p>a</p>b", None, "", "<i>x"] * 5)
    got = html.html_to_text.func(pages)
    assert isinstance(got, pa.Array) and got.to_pylist() == [page_text(p) for p in pages.to_pylist()]
    assert html.html_to_text.func(pages.slice(0, 0)).to_pylist() == []
