import datetime as dt
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from verdant.sources import xlsx as X


def test_formats():
    kinds = {"General": None, "0.00E+00": None, '#,##0 "days"': None, "[Red]0.0;yyyy": None, "@": None, "yyyy\\-mm\\-dd": "date", "mmm": "date", "[$-416]d/m/yy;@": "date", "h:mm AM/PM": "time", "mm:ss.0": "time", "d/m/yy h:mm": "datetime", "[h]:mm": "elapsed"}
    assert {k: X.format_kind(k) for k in kinds} == kinds


def test_dates_and_numbers():
    cases = [("1", "date", "1900-01-01"), ("59", "date", "1900-02-28"), ("60", "date", "60"), ("61", "date", "1900-03-01"), ("43831", "date", "2020-01-01"), ("43831.5", "date", "2020-01-01 12:00:00"), ("43831", "datetime", "2020-01-01 00:00:00")]
    cases += [("0.999988425925926", "time", "23:59:59"), ("43831.000011585648", "time", "2020-01-01 00:00:01.001"), ("1.5", "elapsed", "36:00:00"), ("-1", "date", "-1"), ("2958465", "date", "9999-12-31"), ("2958466", "date", "2958466")]
    for serial, kind, want in cases:
        assert X.date_text(serial, kind) == want, serial
    assert X.date_text("0", "date", True) == "1904-01-01" and X.date_text("60", "date", True) == "1904-03-01"
    assert [X.number_text(v) for v in ("7", "007", "0.10000000000000001", "1.5E-3", "2.0", "1E+20")] == ["7", "007", "0.1", "0.0015", "2", "1e+20"]


@pytest.mark.parametrize("from_1904", [False, True])
def test_styles_and_errors(spark, tmp_path, from_1904):
    path, main = str(tmp_path / "w.xlsx"), f'xmlns="{X._MAIN[1:-1]}"'
    cells = '<c t="str"><v>a</v></c><c t="str"><v>b</v></c>'
    rows = '<c s="1"><v>100</v></c><c s="2"><v>100.25</v></c>', '<c t="e" s="1"><v>#N/A</v></c><c s="9"><v>1.0</v></c>', '<c s="1" t="s"><v>0</v></c><c s="1"/>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{X._REL[1:-1]}"><workbookPr date1904="{from_1904:d}"/><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", X._PARTS["xl/_rels/workbook.xml.rels"])
        z.writestr("xl/styles.xml", f'<styleSheet {main}><numFmts><numFmt numFmtId="170" formatCode="d/m/yy h:mm"/></numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>a_x0041_</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData><row>{cells}</row>{''.join(f'<row>{r}</row>' for r in rows)}</sheetData></worksheet>")
    day = "1904-04-10" if from_1904 else "1900-04-09"
    assert [tuple(r) for r in X.read_xlsx(spark, path).collect()] == [(day, f"{day} 06:00:00"), (None, "1"), ("aA", None)]


def test_there_and_back(spark, tmp_path, monkeypatch):
    path, odd = str(tmp_path / "books"), ' <a> & "b"\t_x0041_\x01\n\r 😀'
    rows = [(1, odd, dt.date(1900, 1, 1), dt.datetime(1900, 2, 28, 23, 59, 59, 999000), 0.1, True), (2, "", dt.date(1899, 12, 31), dt.datetime(2020, 2, 29), float("inf"), False), (None,) * 6]
    df = spark.createDataFrame(rows, "n long, t string, d date, at timestamp_ntz, x double, f boolean").repartition(2)
    X.write_xlsx(df, path)
    want = {("1", odd, "1900-01-01", "1900-02-28 23:59:59.999", "0.1", "TRUE"), ("2", "", "1899-12-31", "2020-02-29 00:00:00", "inf", "FALSE"), (None,) * 6}
    back = X.read_xlsx(spark, path)
    assert back.columns == df.columns and back.count() == 3 and {tuple(r) for r in back.collect()} == want
    X.write_xlsx(df.select("f", "n").limit(1), path, mode="append")
    assert X.read_xlsx(spark, path).select("n").count() == 4
    X.write_xlsx(df.where("false"), path)
    assert X.read_xlsx(spark, path).columns == df.columns and X.read_xlsx(spark, path).count() == 0
    monkeypatch.setattr(X, "MOST_ROWS", 3)
    w = X._Writer(path, 'a "sheet"', ["n"], True)
    w.commit([w.write(iter([(i,) for i in range(5)]))])
    assert len(X.workbooks(path)) == 3 and sorted(r["n"] for r in X.read_xlsx(spark, path).collect()) == list("01234")
    assert X.read_xlsx(spark, path).rdd.getNumPartitions() == 3


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "none")
    bad = spark.range(20).repartition(2).select(F.when(F.col("id") < 19, F.col("id")).otherwise(F.raise_error(F.lit("no"))).alias("n"))
    with pytest.raises(Exception, match="no"):
        X.write_xlsx(bad, path)
    assert not os.path.exists(path) or os.listdir(path) == []
