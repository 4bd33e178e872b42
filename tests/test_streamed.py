"""Members and XML read piece by piece: the same events, little memory, and what a budget refuses."""

import io
import random
import time
import tracemalloc
import weakref
import zipfile

import pyarrow as pa
import pytest

from folio.operators import containers, rows
from folio.operators.containers import Container, events, streamed_events
from folio.operators.spreadsheet import read_xlsx, xlsx_rows

XML = ['<a:b c="1" d=\'>&lt;\'>', "</a:b>", "text &amp; more", "<e/>", "<![CDATA[ <raw> ]] &amp; ]]>", "<!-- a > b -- -->", "<?pi > ?>", "<!DOCTYPE x>", "é日", "<", "<!", "<![CD", '<open x="', "<t>", "\n", ">", "]]>", "-->"]


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_events_do_not_depend_on_pieces():
    rnd = random.Random(4)
    for _ in range(1500):
        xml = "".join(rnd.choice(XML) for _ in range(rnd.randrange(12)))
        cuts = sorted(rnd.randrange(len(xml) + 1) for _ in range(rnd.randrange(6)))
        pieces = [xml[a:b] for a, b in zip([0, *cuts], [*cuts, len(xml)], strict=True)]
        assert list(streamed_events(pieces)) == list(events(xml)), (xml, pieces)
        assert list(streamed_events(list(xml))) == list(events(xml))


def test_long_tags_take_linear_time():
    for xml in ('<a b="' + "x" * 8_000_000 + '"/>', "<![CDATA[" + "x" * 8_000_000 + "]]>", "y" * 8_000_000):
        began = time.perf_counter()
        assert list(streamed_events(xml[k : k + 10_000] for k in range(0, len(xml), 10_000))) == list(events(xml))
        assert time.perf_counter() - began < 5


def test_characters_over_the_end_of_a_piece(monkeypatch):
    monkeypatch.setattr(containers, "WHOLE", 10)
    monkeypatch.setattr(containers, "PIECE", 7)
    text = "<a>" + "é日👩" * 50 + "</a>"
    assert list(Container(zipped(x=text)).xml("x")) == list(events(text))
    broken = text.encode()[:-6]
    assert list(Container(zipped(x=broken)).xml("x")) == list(events(broken.decode("utf-8", "replace")))


def test_damaged_members_are_missing(monkeypatch):
    monkeypatch.setattr(containers, "WHOLE", 10)
    whole = zipped(x="<a>" + "".join(f"<b>{k}</b>" for k in range(3000)) + "</a>")
    raw = bytearray(whole)
    raw[3000] ^= 255
    archive = Container(bytes(raw))
    assert list(archive.xml("x")) == [] and archive.refused == []
    assert len(list(Container(whole).xml("x"))) == 9002


def sheet(n):
    return "<worksheet><sheetData>" + "".join(f'<row><c r="A{k}" t="s"><v>{k % 7}</v></c><c><v>{k}.5</v></c></row>' for k in range(n)) + "</sheetData></worksheet>"


def workbook(n, strings=7):
    return zipped(
        **{
            "xl/worksheets/sheet1.xml": sheet(n), "xl/worksheets/sheet2.xml": sheet(2), "xl/sharedStrings.xml": "<sst>" + "".join(f"<si><t>s{k}</t></si>" for k in range(strings)) + "</sst>",
            "xl/workbook.xml": '<workbook><sheets><sheet name="one" r:id="a"/><sheet name="two" r:id="b"/></sheets></workbook>', "xl/styles.xml": "<styleSheet><cellXfs><xf/></cellXfs></styleSheet>",
        }
    )


def test_memory_of_a_large_sheet():
    """A sheet of 9 MB of XML, within 4 MB besides the archive."""
    content = workbook(150_000)
    assert Container(content).declared("xl/worksheets/sheet1.xml") > 8_000_000
    tracemalloc.start()
    n = sum(1 for r in xlsx_rows("/x", content, None, None, None) if r[1] == "cell")
    assert n == 300_004 and tracemalloc.get_traced_memory()[1] < 4_000_000 + len(content)
    tracemalloc.stop()


@pytest.mark.parametrize("budget", [10**9, 30_000])
def test_a_budget_loses_sheets_not_strings(spark, budget):
    files = spark.createDataFrame([("/x.xlsx", workbook(1000))], "path string, content binary")
    rows = read_xlsx(files, budget=budget).collect()
    assert [r.text for r in rows if r.kind == "string"] == [f"s{k}" for k in range(7)]
    assert [r.sheet_name for r in rows if r.kind == "sheet"] == (["one", "two"] if budget > 30_000 else ["two"])
    assert [r.text for r in rows if r.kind == "refused"] == ([] if budget > 30_000 else ["xl/worksheets/sheet1.xml"])


def test_a_reader_holds_one_batch_and_little_of_what_it_made(spark):
    """Input batches go before the next is asked for, and batches that were handed on before the next is made."""
    held, made = [], []

    class Frame:
        def mapInArrow(self, run, schema):
            return run

    def batches():
        for _ in range(4):
            assert all(w() is None for w in held)
            batch = pa.RecordBatch.from_arrays([pa.array(["x" * 1_000_000] * 12)], names=["text"])
            held.append(weakref.ref(batch))
            yield batch
            del batch

    run = rows.expand(Frame(), lambda row: [(row["text"],)], "text string")
    for out in run(batches()):
        made.append((out.num_rows, out.nbytes))
        del out
    assert sum(n for n, _ in made) == 48 and max(size for _, size in made) < 6_000_000
