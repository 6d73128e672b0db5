"""Replacement, vault, segments, restoration, streams, commands, cells, readers."""

import io
import zipfile

from pyspark.sql import functions as F

from pseudolake.functions import catalog as cat
from pseudolake.functions import text as tx
from pseudolake.operators import replace, segments, vault
from pseudolake.plans import jobs
from pseudolake.sources import readers
from pseudolake.streaming import restore


def test_round_trip_numbering_and_literal_values(spark):
    rows = [(1, "s", "a@b.ru и c@d.ru, снова a@b.ru"), (2, "s", "c@d.ru $1 \\g<0>"), (3, "t", None), (4, "t", "")]
    df = spark.createDataFrame(rows, "doc_id long, session_id string, text string")
    texts, new, _ = jobs.anonymize_texts(df, catalog=cat.only("EMAIL"), expand=True)
    texts, new = texts.checkpoint(), new.checkpoint()
    got = {r.doc_id: r.text for r in texts.collect()}
    assert got[1] == "[EMAIL_1] и [EMAIL_2], снова [EMAIL_1]" and got[3] is None and got[4] == ""
    assert {r.doc_id: r.text for r in jobs.restore(texts, new, ["doc_id"]).collect()} == {i: t for i, _, t in rows}
    assert replace.leaks(texts, new).count() == 0
    v = spark.createDataFrame([("s", "[A_1]", "Иван \\g<0> [B_1] $2"), ("s", "[B_1]", "x")], "session_id string, token string, original_value string")
    t = spark.createDataFrame([(1, "s", "[A_1] [B_1] [C_9]")], "doc_id long, session_id string, text string")
    assert jobs.restore(t, v, ["doc_id"]).first().text == "Иван \\g<0> [B_1] $2 x [C_9]"


def test_dictionary_and_redaction(spark):
    t = spark.createDataFrame([(1, "s", "3 и 13, 2023-3x [MONEY_63] Иванов иванова 386887,42 ИВАНОВ")], "doc_id long, session_id string, text string")
    d = spark.createDataFrame([("s", "3", "[ORG_120]")], "session_id string, value string, token string")
    assert replace.replace_by_value(t, d, ["doc_id"], ["session_id"]).first().text.startswith("[ORG_120] и 13, 2023-3x [MONEY_63]")
    out, new, report = jobs.extra_redact(t, ["Иванов", "386887", "Нет"], jobs.empty_vault(t), ["doc_id"])
    text = out.first().text
    assert "Иванов " not in text and "ИВАНОВ" not in text and "иванова" in text and "386887" not in text and ",42" not in text and "[MONEY_63]" in text
    assert {(r.value, r.found) for r in report.collect()} >= {("Иванов", True), ("Нет", False)}
    assert {r.entity_type for r in new.collect()} == {"PERSON", "MISC"}


def test_segments_and_allocators(spark):
    seg = spark.createDataFrame([("c", 0, "s", "Привет"), ("c", 1, "s", "Мой email: a@b.ru"), ("c", 2, "s", None)], "conv_id string, turn int, session_id string, text string")
    out = {r.turn: r.text for r in jobs.anonymize_segments(seg, "conv_id", "turn", catalog=cat.only("EMAIL"))[0].collect()}
    assert out == {0: "Привет", 1: "Мой email: [EMAIL_1]", 2: None}
    two = spark.createDataFrame([("c", 0, "Sasha"), ("c", 1, "А.В. Гершойг")], "conv_id string, turn int, text string")
    sp = spark.createDataFrame([("c", 0, 18, "Sasha\nА.В. Гершойг", "PERSON", 1.0)], "conv_id string, start int, end int, value string, type string, confidence double")
    got = {(r.turn, r.start, r.end, r.value, round(r.confidence, 2)) for r in segments.split_by_segments(sp, two, "conv_id", "turn").collect()}
    assert got == {(0, 0, 5, "Sasha", 0.8), (1, 0, 12, "А.В. Гершойг", 0.8)}
    s = spark.createDataFrame([("x", i, i, i + 1, f"v{i % 5}", "ORG" if i % 2 else "LOC") for i in range(20)], "session_id string, doc_id int, start int, end int, value string, type string")
    one = {(r.token, r.original_value) for r in vault.assign_tokens(s, jobs.empty_vault(s), ["doc_id"]).collect()}
    all_ = {(r.token, r.original_value) for r in vault.assign_tokens_globally(s, ["doc_id"]).collect()}
    assert one == all_ and len(one) == 5
    old = spark.createDataFrame([("x", "[ORG_7]", "v1", "ORG")], "session_id string, token string, original_value string, entity_type string")
    more = {r.original_value: r.token for r in vault.assign_tokens(s, old, ["doc_id"]).collect()}
    assert "v1" not in more and more["v0"] == "[LOC_8]"
    assert vault.assign_tokens(s, old, ["doc_id"], "hash").count() == 4


def test_stream_joins_torn_tokens(spark, tmp_path):
    rows = [("a", "content", 0, "Привет, [PER", False), ("a", "content", 1, "SON_1]!", True), ("a", "tool", 0, '{"t": "[PER', False), ("a", "tool", 1, 'SON_1]"}', False), ("a", "tool", 2, "", True), ("b", "content", 0, "x [open", True)]
    chunks = spark.createDataFrame(rows, "stream_id string, channel string, seq long, text string, is_last boolean")
    v = spark.createDataFrame([("a", "[PERSON_1]", "Иван Петров")], "stream_id string, token string, original_value string")
    got = {(r.stream_id, r.channel): r.text for r in restore.collected(restore.restore_all(chunks, v, str(tmp_path / "s"), ("content",))).collect()}
    assert got == {("a", "content"): "Привет, Иван Петров!", ("a", "tool"): '{"t": "[PERSON_1]"}', ("b", "content"): "x [open"}
    assert restore.safe_prefix("a [b] [c") == ("a [b] ", "[c") and restore.safe_prefix("a]b") == ("a]b", "")


def test_commands_and_cells_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    spec = lambda t: one(tx.parse_placeholder_spec(F.lit(t)))
    assert spec("PERSON_1, [PERSON_3]-PERSON_5 и ORG_2").tokens == ["[PERSON_1]", "[PERSON_3]", "[PERSON_4]", "[PERSON_5]", "[ORG_2]"]
    for t in ("PERSON_3–PERSON_5", "PERSON_3..PERSON_5", "PERSON_3 - 5", "с PERSON_3 по PERSON_5"):
        assert spec(t).tokens == ["[PERSON_3]", "[PERSON_4]", "[PERSON_5]"]
    bad = spec("PERSON_3–ORG_5 и FOO_1 и PERSON_9–PERSON_2")
    assert bad.tokens == [] and len(bad.errors) == 3
    vals = lambda t: one(tx.parse_value_list(F.lit(t)))["values"]
    assert vals(": Иванов, Петрова и «Сидоров И. И.» в файле C:\\docs\\KP.docx")[:2] == ["Иванов", "Петрова"]
    assert vals(": 386887,42, 51903,14 и 7 432 480,00") == ["386887,42", "51903,14", "7 432 480,00"] and vals(": 386887; 42") == ["386887", "42"]
    shown = lambda n, f: one(tx.render_number(F.lit(n), F.lit(f)))
    assert shown("1586238.422", "#,##0.00 ₽") == "1 586 238,422 ₽" and shown("-1500", "# ##0") == "-1 500" and shown("7", "General") is None
    assert [one(tx.currency_of_format(F.lit(f))) for f in ('[$€-407]', '0.00\\ [$₽-419]', '#,##0 "руб."', "General")] == ["€", "₽", "руб.", ""]
    assert one(tx.restore_number(F.lit("386 887,42 ₽"))) == 386887.42 and one(tx.restore_number(F.lit("x1"))) is None
    c = one(tx.coerce_value(F.lit("3.4.2023")))
    assert str(c.date) == "2023-04-03" and one(tx.coerce_value(F.lit("12")))["int"] == 12 and one(tx.coerce_value(F.lit("1.5")))["float"] == 1.5
    assert one(tx.result_path(F.lit("a/b.anonymized.docx"))) == "a/b.result.docx" and one(tx.norm_path(F.lit('"C:\\A%20b\\c.TXT"'))) == "c:/a b/c.txt"
    assert one(tx.markers(F.lit("[anonymizer:copy:/a/b] [anonymizer:copy:<путь>]"), "copy")) == ["/a/b"]
    assert [one(tx.valid_session_id(F.lit(x))) for x in ("abc-123_XYZ", "../../etc/passwd", "a b", "x" * 65)] == [True, False, False, False]


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Привет".encode("cp1251"))
    (tmp_path / "b.md").write_bytes("Привет é".encode())
    (tmp_path / "c.bin").write_bytes(b"x")
    got = {r.doc_id[-5:]: r.text for r in readers.read_text_docs(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "Привет", "/b.md": "Привет é"}
    xml = b"<r><p Author='Ivan'>one<i>two</i>tail</p></r>"

    def zipped(files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for k, v in files.items():
                z.writestr(k, v)
        return out.getvalue()

    docx = zipped({"word/document.xml": "<w:d xmlns:w='w'><w:body><w:p><w:r><w:t>Para</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:t>Cell</w:t></w:p></w:tc></w:tr></w:tbl></w:body></w:d>"})
    xlsx = zipped({
        "xl/workbook.xml": "<w xmlns:r='r'><sheets><sheet name='S' r:id='x1'/></sheets></w>", "xl/_rels/workbook.xml.rels": "<R><Relationship Id='x1' Target='worksheets/sheet1.xml'/></R>",
        "xl/sharedStrings.xml": "<s><si><t>Name</t></si></s>", "xl/worksheets/sheet1.xml": "<w><sheetData><row><c r='A1' t='s'><v>0</v></c><c r='AB2'><v>5.5</v></c><c r='C3'><f>B2*2</f></c></row></sheetData></w>",
    })
    files = spark.createDataFrame([("x.xml", xml), ("d.docx", docx), ("e.xlsx", xlsx), ("bad", b"zz")], "path string, content binary")
    assert [r.text for r in readers.read_xml_segments(files.where("path = 'x.xml'")).collect()] == ["one", "Ivan", "two", "tail"]
    assert [(r.kind, r.text) for r in readers.read_docx_segments(files.where("path = 'd.docx'")).collect()] == [("para", "Para"), ("cell", "Cell")]
    assert [(r.row, r.col, r.value, r.value_type) for r in readers.read_xlsx_cells(files.where("path = 'e.xlsx'")).collect()] == [(1, 1, "Name", "string"), (2, 28, "5.5", "number"), (3, 3, "=B2*2", "formula")]
    assert readers.read_docx_segments(files.where("path = 'bad'")).first().error.startswith("BadZipFile")
    m = spark.createDataFrame([(1, '{"messages":[{"role":"user","content":[{"type":"text","text":"a"},{"type":"image_url"}]},{"role":"assistant","content":null,"tool_calls":[{"id":"1","function":{"name":"f","arguments":"{}"}}]}]}')], "conv_id long, request string")
    got = readers.read_messages(m).collect()
    assert [r.text for r in got] == ["a", None] and got[1].tool_calls[0].name == "f"
