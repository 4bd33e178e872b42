"""PDF objects, filters, content streams; damaged files; memory and time of long ones."""

import base64
import random
import time
import zlib

import pytest

from folio.operators import pdf as P
from folio.operators.pdf_objects import BUDGET, Name, Op, Pdf, Ref, TooLarge, base_85, lzw, run_lengths, tokens, unpredicted
from folio.sources.build import lzw_packed, pdf
from folio.sources.work import dealt

LINES = ["one two  three", "", "über (naïve) \\ back ) slash 日本 👩‍👩", " ".join(f"w{k}" for k in range(40)), "\tx\x0by"]
TEXTS = ["one two three", "", "über (naïve) \\ back ) slash 日本 👩‍👩", "\n".join(" ".join(f"w{k}" for k in range(at, min(40, at + 12))) for at in range(0, 40, 12)), "x y"]


def read(spark, *contents, **how):
    files = spark.createDataFrame([(f"/{k}", c) for k, c in enumerate(contents)], "path string, content binary")
    return P.read_pdf(files, **how)


def texts(spark, content, **how):
    return [r.text for r in P.page_texts(read(spark, content, **how)).orderBy("page").collect()]


@pytest.mark.parametrize("form", [0, 1, 2])
def test_pages_come_back(spark, form):
    rows = read(spark, pdf(LINES, form))
    pages = P.page_texts(rows).orderBy("page").collect()
    assert [p.text for p in pages] == TEXTS
    assert [(p.width, p.height, p.n_links, p.rotation) for p in pages[:2]] == [(500, 800, 0, 0), (600, 800, 1, 0)]
    assert [(r.page, r.x, r.target) for r in P.links(rows).orderBy("page").collect()] == [(2, 1, "https://h.example/1"), (4, 1, "https://h.example/3")]
    run = rows.where("kind = 'run' and page = 1").orderBy("seq").first()
    assert (run.x, run.y, run.size) == (9, 700, 20)
    assert P.counted_pages(pdf(LINES, form)) == (5, False)


def test_values():
    data = b"<< /A#20B [1 -2.5 .5 true null 7 0 R (a\\(b\\)\\051(c)\\\r\nd\\n) <4 1 4> /] /X << >> >> Tj % note\n/N"
    assert [v for v, _ in tokens(data)] == [{"A B": [1, -2.5, 0.5, True, None, Ref(7), b"a(b))(c)d\n", b"A@", Name("")], "X": {}}, Op(b"Tj"), Name("N")]
    assert [v for v, _ in tokens(b"(open")] == [b"open"] and [v for v, _ in tokens(b") >> ] 1 0 Rx")] == [1, 0, Op(b"Rx")]


def test_filters():
    rnd = random.Random(1)
    data = bytes(rnd.choice(b"abcab") for _ in range(5000))
    assert lzw(lzw_packed(data)) == data
    # codes that grow: the encoder of the format, with a table
    table, width, bits, word = {bytes([k]): k for k in range(256)}, 9, f"{256:09b}", b""
    size = 258
    for c in data:
        if word + bytes([c]) in table:
            word += bytes([c])
            continue
        bits += f"{table[word]:0{width}b}"
        table[word + bytes([c])], size = size, size + 1
        width = 10 if size + 1 > 512 and width == 9 else 11 if size + 1 > 1024 and width == 10 else 12 if size + 1 > 2048 and width == 11 else width
        word = bytes([c])
    bits += f"{table[word]:0{width}b}"
    bits += f"{257:0{width}b}"
    packed = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8))
    assert lzw(packed) == data
    assert run_lengths(bytes([2, 1, 2, 3, 254, 9, 128, 7])) == bytes([1, 2, 3, 9, 9, 9]) and base_85(b"87c URD\nZ~>") == b"Hello"
    rows = [bytes(rnd.randrange(256) for _ in range(6)) for _ in range(9)]
    made, above = b"", bytes(6)
    for k, row in enumerate(rows):
        kind = k % 5
        left, corner = b"\0\0" + row[:-2], b"\0\0" + above[:-2]

        def paeth(a, b, c):
            p = a + b - c
            return a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c

        guess = [[0] * 6, left, above, [(a + b) // 2 for a, b in zip(left, above, strict=True)], [paeth(*x) for x in zip(left, above, corner, strict=True)]][kind]
        made += bytes([kind]) + bytes((x - g) % 256 for x, g in zip(row, guess, strict=True))
        above = row
    assert unpredicted(made, {"Predictor": 15, "Columns": 3, "Colors": 2}) == b"".join(rows)
    assert unpredicted(bytes([1, 2, 3, 1]), {"Predictor": 2, "Columns": 2}) == bytes([1, 3, 3, 4])


def file_of(*objects, trailer=b"<< /Root 1 0 R >>"):
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj %s endobj\n" % (k, o) for k, o in enumerate(objects, 1)) + b"trailer " + trailer


def one_page(content, resources=b"/Font << /F 4 0 R >>", font=b"<< /Subtype /Type1 /FirstChar 65 /Widths [1000 500] >>", *more):
    return file_of(b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Kids [3 0 R 3 0 R] >>", b"<< /Type /Page /Contents 5 0 R /Rotate 90 /Resources << %s >> >>" % resources, font, b"<< /Length 0 >> stream\n%s\nendstream" % content, *more)


def test_drawing(spark):
    assert texts(spark, one_page(b"BT /F 10 Tf (A) Tj 14 TL (B) ' 2 1 (C) \" 1 0 0 1 50 -28 Tm [(D) -100 (E) -250 (F)] TJ ET")) == ["A\nB\nC DE F"]
    font = b"<< /Subtype /Type1 /Encoding << /BaseEncoding /MacRomanEncoding /Differences [65 /eacute /uni20AC 70 /Ccedilla /nonesuch] >> >>"
    assert texts(spark, one_page(b"BT /F 1 Tf (ABCFG\\212) Tj ET", font=font)) == ["é€CÇ�ä"]
    form = b"<< /Type /XObject /Subtype /Form /Matrix [1 0 0 1 5 5] /Length 0 >> stream\nBT /F 1 Tf (in) Tj ET /Me Do\nendstream"
    page = one_page(b"q /Me Do Q BT /F 1 Tf 0 -9 Td (out) Tj ET", b"/Font << /F 4 0 R >> /XObject << /Me 6 0 R >>", b"<< /Subtype /Type1 >>", form)
    text = texts(spark, page)[0]
    assert text.count("in") == P.FORMS and text.endswith("\nout")  # a form in itself is drawn so often
    assert texts(spark, one_page(b"BT /None 1 Tf (x) Tj Tj [ ] TJ 1 Td /F 1 Tf (y) Tj ET")) == ["y"]


def test_cmaps():
    m = P.CMap(b"1 begincodespacerange <00> <FF> endcodespacerange 2 beginbfchar <01> <0041> <02> <00660069> endbfchar 2 beginbfrange <10> <12> <0061> <20> <21> [<0078> <D83DDE00>] endbfrange")
    assert [m.meaning(k) for k in (1, 2, 0x11, 0x21, 0x22, 0)] == [b"\0A", b"\0f\0i", b"\0b", b"\xd8\x3d\xde\x00", None, None] and m.code_bytes == 1


def test_faults_are_rows(spark):
    good = pdf(LINES[:1], 0)
    cases = [b"", None, b"%PDF-1.4", good.replace(b"FlateDecode", b"FlateDecodf"), good.replace(b"startxref", b"startxxxx"), file_of(b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Kids [2 0 R] >>"), file_of(b"<< /Root 1 0 R >>", trailer=b"<< /Encrypt 1 0 R >>"), b"[" * 10_000, pdf([], 0)]
    rows = {r.path: (r.page, r.text) for r in read(spark, *cases).where("kind = 'file'").collect()}
    assert len(rows) == len(cases) and rows["/3"] == (1, None) and rows["/4"] == (1, None) and rows["/6"] == (0, "the document is encrypted")
    assert all(rows[f"/{k}"] == (0, "no pages could be read") for k in (0, 1, 2, 5, 7, 8))
    assert texts(spark, cases[4]) == ["one two three"] and texts(spark, cases[3]) == [""]
    bomb = one_page(b"").replace(b"<< /Length 0 >> stream\n", b"<< /Length 0 /Filter /FlateDecode >> stream\n" + zlib.compress(bytes(1 << 20)))
    assert read(spark, bomb, budget=1000).where("kind = 'file'").first().text == "streams inflate beyond the limit"
    rnd = random.Random(3)
    for _ in range(300):  # whatever is changed, it ends and raises nothing but what is told
        raw = bytearray(pdf(LINES[:2], rnd.randrange(3)))
        for _ in range(rnd.randrange(1, 9)):
            raw[rnd.randrange(len(raw))] = rnd.randrange(256)
        assert P.counted_pages(bytes(raw))[0] >= 0


def test_page_counts_of_long_files():
    """Many object streams take linear time, and a count that had to stop says so."""
    one = b"1 0 obj << /Type /ObjStm >>\nstream\n" + zlib.compress(b"<< /Type /Page >>" * 50) + b"\nendstream\n"
    began = time.perf_counter()
    assert P.packed_pages(b"%PDF-1.5\n" + (one + bytes(10_000)) * 4000, BUDGET) == (200_000, False)
    assert time.perf_counter() - began < 10
    big = b"<< /Type /ObjStm >>\nstream\n" + zlib.compress((b"<< /Type /Page >>" + bytes(983)) * 5000) + b"\nendstream"
    assert P.packed_pages(big, BUDGET) == (5000, False)
    n, partial = P.packed_pages(big, 2_000_000)
    assert partial and 1500 < n < 5000


def test_long_pages(spark):
    line = " ".join(f"word{k}" for k in range(30_000))
    began = time.perf_counter()
    assert texts(spark, pdf([line], 2))[0].split() == line.split()
    assert time.perf_counter() - began < 20
    with pytest.raises(TooLarge):
        p = Pdf(pdf([line], 0), 1000)
        [p.content(p.get(page["Contents"])) for page in p.pages()]


def test_objects_of_a_long_file_are_looked_up_once():
    """An object stream with very many objects is no list that each look goes over."""
    p = Pdf(pdf(["a"] * 3000, 1))
    assert sum(1 for _ in p.pages()) == 3000
    (found,) = p.packed.values()
    assert isinstance(found, dict) and len(found) == 3003 and all(p._packed(holder) is found for holder in p.packed)


def test_instructions_read_in_one_go_are_those_of_tokens():
    def by_tokens(data):
        held, it = [], tokens(data)
        while (got := next(it, None)) is not None:
            value, at = got
            if not isinstance(value, Op):
                held.append(value)
                continue
            if value == b"ID":
                end = P.IN_LINE_END.search(data, at)
                it = tokens(data, end.end() if end else len(data))
            else:
                yield value, held
            held = []

    rnd = random.Random(5)
    pieces = [b"1", b"-2.5", b".5", b"4.", b"+7", b"0 R", b"3 0 R", b"R*", b"Tj", b"TJ", b"Td", b"T*", b"'", b'"', b"true", b"null", b"nulls", b"ID", b"EI", b"BI", b"/F1", b"(a)", b"(a\\051)", b"((b)", b")", b"<41>", b"<4 1 4>", b"<4x>", b"[", b"]", b"[<41> -300 (b) 5.]", b"<<", b">>", b"% c", b"{", b"1x", b"\0"]
    for _ in range(20_000):
        data = b"".join(rnd.choice(pieces) + rnd.choice([b" ", b"\n", b"", b"  "]) for _ in range(rnd.randrange(9)))
        assert list(P.instructions(data)) == list(by_tokens(data)), data


def test_filters_by_whole_stretches():
    rnd = random.Random(2)
    for n in range(40):
        raw = bytes(rnd.choice(b"\0\0\0ab") for _ in range(n))
        assert base_85(base64.a85encode(raw) + b"~>") == raw and lzw(lzw_packed(raw * 30)) == raw * 30
    for damaged in (b"uuuuu", b"s8W-\"", b"ab\x7fcd", b"!z!!!!"):
        with pytest.raises(ValueError):
            base_85(damaged)
    with pytest.raises(TooLarge):
        lzw(lzw_packed(bytes(5000)), limit=1000)


@pytest.mark.parametrize("form", [0, 1, 2])
def test_pages_of_many_runs_come_in_rows_of_few(spark, form):
    """A page is a row with its runs in it; one with more runs than are held at once is several, with the same text."""
    files = spark.createDataFrame([("/0", pdf(LINES, form))], "path string, content binary")
    assert P.read_pages(files).where("kind = 'page'").count() == len(LINES)
    rows = P.read_pages(files, at_once=1).cache()
    assert rows.where("size(text) > 1").count() == 0 and rows.where("page = 4").count() == {0: 4, 1: 40, 2: 4}[form]
    pages = P.texts_of(rows).orderBy("page").collect()
    assert [p.text for p in pages] == TEXTS and [(p.width, p.height, p.n_links, p.rotation) for p in pages[:2]] == [(500, 800, 0, 0), (600, 800, 1, 0)]
    assert pages == P.page_texts(P.read_pdf(files)).orderBy("page").collect()


def test_stepped_strings_are_drawn_as_one_by_one(monkeypatch):
    rnd = random.Random(7)
    pieces = [b"<0041>", b"<0042 0043> Tj", b"<> Tj", b"3 0 Td", b"-7.5 2 Td", b"<0044> Tj 12 0 Td", b"<0045> Tj 9 -14 Td", b"[<0046> -300 <0047>12] TJ", b"T*", b"2 Ts", b"0 Ts", b"/F 8 Tf", b"/G 8 Tf", b"2 0 .5 2 9 7 cm", b"1 0 1 1 4 4 Tm", b"q", b"Q", b"1 Tc", b"(\0H) Tj"]
    pages = [b"BT /F 10 Tf " + b"\n".join(rnd.choice(pieces) for _ in range(rnd.randrange(30))) for _ in range(300)]
    file = Pdf(pdf(["a"], 0))
    resources = {"Font": {"F": Ref(3)}}
    drawn = lambda: [[run for runs in P.Drawing(file, P.Fonts()).runs(data, resources) for run in runs] for data in pages]
    together = drawn()
    monkeypatch.setattr(P, "STRETCH", P.re.compile(rb"(?!)"))
    apart = drawn()
    assert sum(map(len, apart)) > 600 and [[r[4] for r in page] for page in together] == [[r[4] for r in page] for page in apart]
    assert all(x == pytest.approx(y) for a, b in zip(together, apart, strict=True) for r, s in zip(a, b, strict=True) for x, y in zip(r[:4], s[:4], strict=True))


def test_files_share_fonts_only_if_equal(spark):
    """Fonts under one number that differ in a name or a width stay apart; what is kept of them is bounded."""
    fonts = [b"<< /Subtype /Type1 /Encoding << /Differences [65 /%s] >> /FirstChar 65 /Widths [%d] >>" % (name, width) for name, width in ((b"eacute", 500), (b"B", 500), (b"B", 5000), (b"eacute", 500))]
    files = [one_page(b"BT /F 10 Tf (A) Tj 8 0 Td (A) Tj ET", font=f) for f in fonts]
    rows = P.page_texts(read(spark, *files)).where("page = 1").orderBy("path").collect()
    assert [r.text for r in rows] == ["é é", "B B", "BB", "é é"]
    shared = P.Fonts()
    for k in range(3):
        font = shared.font(Pdf(files[k]), Pdf(files[k]).get(Ref(4)))
        pace = font.pace(10.0, 0.0, 0.0, 1.0)
        for n in range(P.KEPT // 2):
            pace.strings[b"%d" % n]
        assert shared.n <= P.KEPT and sum(map(len, shared.kept)) == shared.n


def test_texts_of_one_row_group_are_dealt_out(spark, tmp_path):
    """Partitions that lie within one row group of a file are empty but for one; the work is dealt out all the same."""
    spark.range(4000).selectExpr("id", "repeat(uuid(), 20) AS text").coalesce(1).write.option("compression", "none").parquet(str(tmp_path / "t"))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
        rows = spark.read.parquet(str(tmp_path / "t"))
        assert rows.rdd.getNumPartitions() > 4
        shares = [len(x) for x in dealt(rows).rdd.glom().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert len(shares) >= 16 and max(shares) < 2 * 4000 / len(shares)
