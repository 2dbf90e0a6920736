import zipfile

import pytest
from pyspark.sql import functions as F

from assayflow.operators.contracts import ContractError
from assayflow.sources import documents, sequence_files, sinks, text_tables
from assayflow.streaming.incremental import route_stream, without_repeats


def test_delimited(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("﻿Iso Late\tMIC (mg/L)\nx\t0.5\ny\t\n", "utf-8")
    df = text_tables.read_table(spark, str(tmp_path / "a.tsv"), canonical=True)
    assert df.columns == ["iso_late", "mic_mg_l"] and [tuple(r) for r in df.collect()] == [("x", "0.5"), ("y", None)]
    (tmp_path / "b.csv").write_text("a,a\n1,2\n")
    with pytest.raises(ContractError):
        text_tables.read_table(spark, str(tmp_path / "b.csv"))
    with pytest.raises(ContractError):
        text_tables.read_table(spark, str(tmp_path / "a.tsv"), required=["q"])
    kv = spark.createDataFrame([("f", "Total length", "5,000,000"), ("f", "N50", "x")], "file string, k string, v string")
    assert text_tables.key_value_report(kv, "k", "v", ["file"]).first()["values"] == {"Total length": 5e6}


def test_fasta_and_gff(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">c1 some words\nACGT\nacgn\n>c2\nTT\n")
    rows = {r.name: r for r in sequence_files.read_fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert rows["c1"].sequence == "ACGTACGN" and rows["c1"].description == "some words" and rows["c2"].counts.length == 2
    lines = sequence_files.fasta_lines(spark.createDataFrame([("x", "A" * 5)], "n string, s string"), "n", "s", 2).first().value
    assert lines == ">x\nAA\nAA\nA"
    (tmp_path / "a.gff").write_text("##gff-version 3\nc1\tp\tgene\t3\t9\t.\t-\t.\tID=g1;gene=gyrA\nc1\tp\tCDS\t3\t9\t.\t-\t.\tID=c1\n")
    got = {r.gene: (r.n_features, r.locus) for r in sequence_files.panel_genes(sequence_files.read_gff(spark, str(tmp_path / "a.gff")), ["gyrA", "parC"]).collect()}
    assert got["gyrA"][0] == 1 and got["gyrA"][1].strand == "-" and got["parC"] == (0, None)


def test_xml_and_json(spark, tmp_path):
    xml = '<BioSampleSet><BioSample accession="SAMN1" submission_date="2020"><Description><Comment><Table><Header><Cell>Antibiotic</Cell><Cell>MIC</Cell></Header><Body><Row><Cell>x</Cell><Cell>2</Cell></Row><Row><Cell>y</Cell></Row></Body></Table></Comment></Description></BioSample></BioSampleSet>'
    rows = documents.antibiogram_rows(spark.createDataFrame([(xml,), ("<broken",), (None,)], "x string"), "x").orderBy("row_index").collect()
    assert [(r.accession, r.fields["antibiotic"], r.fields["mic"]) for r in rows] == [("SAMN1", "x", "2"), ("SAMN1", "y", None)] and rows[0].row_id != rows[1].row_id
    sra = '<EXPERIMENT_PACKAGE><EXPERIMENT accession="E"/><SAMPLE accession="S"><SAMPLE_ATTRIBUTES><SAMPLE_ATTRIBUTE><TAG>strain</TAG><VALUE>k</VALUE></SAMPLE_ATTRIBUTE></SAMPLE_ATTRIBUTES></SAMPLE><RUN_SET><RUN accession="R1"/><RUN accession="R2"/></RUN_SET></EXPERIMENT_PACKAGE>'
    runs = documents.run_rows(spark.createDataFrame([(sra,)], "x string"), "x").collect()
    assert [(r.run, r.attributes) for r in runs] == [("R1", {"strain": "k"}), ("R2", {"strain": "k"})]
    (tmp_path / "r.json").write_text('{"reports": [{"accession": "GCA_000000001.1", "organism": {"organism_name": "o"}}]}')
    assert [r.accession for r in documents.assembly_reports(spark, str(tmp_path / "r.json")).collect()] == ["GCA_000000001.1"]
    d = spark.createDataFrame([("SRR1;SRR1, ",), ("SRR1,SRR2",), (None,)], "x string").select(documents.one_of_list(F.col("x")).alias("o"), documents.accessions(F.lit("a GCA_000000002.1 GCF_000000001.1")).alias("a")).collect()
    assert [r.o for r in d] == ["SRR1", None, None] and d[0].a == ["GCA_000000002.1", "GCF_000000001.1"]


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>drug</t></si><si><r><t>mi</t></r><r><t>c</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>gen</t></is></c><c r="B2"><v>2</v></c></row><row r="3"><c r="A3" t="b"><v>1</v></c></row></sheetData><mergeCells><mergeCell ref="A3:B3"/></mergeCells></worksheet>')
    cells = documents.read_workbooks(spark, str(tmp_path / "w.xlsx"))
    rows = [r.fields for r in documents.sheet_rows(cells).orderBy("row").collect()]
    assert rows == [{"drug": "gen", "mic": "2"}, {"drug": "TRUE"}] and cells.where("merged").count() == 1
    assert documents.unexpected_cells(cells, spark.createDataFrame([("S", 1, 1, "drug"), ("S", 9, 9, "q")], "sheet string, row int, column int, text string")).count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "bad")], "a int, reason string")
    a, b = str(tmp_path / "in"), str(tmp_path / "ex")
    sinks.write_routed(df, "reason", a, b)
    assert spark.read.parquet(a).count() == 1 and spark.read.parquet(b).first().reason == "bad"
    with pytest.raises(Exception, match="exist"):
        sinks.write_new(df, a)
    with pytest.raises(ContractError):
        sinks.distinct_paths(["/x"], ["/x/y"])
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "f.txt").write_text("hello")
    actual = sinks.content_manifest(spark, str(tmp_path / "m"))
    sha = actual.first().sha256
    lines = spark.createDataFrame([(f"{'0' * 64}  f.txt",), (f"{sha}  gone",), ("nonsense",), (f"{sha}  ../up",)], "l string")
    assert {(r.path, r.issue) for r in sinks.manifest_issues(lines, "l", actual).collect()} == {("f.txt", "changed_file"), ("gone", "missing_file"), ("nonsense", "bad_line"), ("../up", "unsafe_path")}
    assert sinks.table_digest(df) == sinks.table_digest(df.repartition(3))
    key = sinks.lock({"a": 1})
    sinks.check_lock({"a": 1}, key)
    with pytest.raises(ContractError):
        sinks.check_lock({"a": 2}, key)
    d = spark.createDataFrame([("x", None)], "b string, a string")
    got = d.select(sinks.row_digest(d, ["a", "b"]).alias("h"), F.sha2(F.lit('[["a",null],["b","x"]]'), 256).alias("w")).first()
    assert got.h == got.w


def test_streams(spark, tmp_path):
    src, a, b = str(tmp_path / "src"), str(tmp_path / "a"), str(tmp_path / "b")
    spark.createDataFrame([("k1", "2020-01-01", 1.0), ("k1", "2020-01-01", 1.0), ("k2", "2020-01-02", -1.0)], "k string, t string, v double").withColumn("t", F.to_timestamp("t")).write.parquet(src)
    stream = without_repeats(spark.readStream.schema("k string, t timestamp, v double").parquet(src), "k", "t")
    route_stream(stream, F.when(F.col("v") <= 0, "nonpositive"), a, b, str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(a).count() == 1 and spark.read.parquet(b).first().reason == "nonpositive"


def test_unreadable_texts_are_listed(spark):
    rows = [("<BioSample/>",), ("<broken",), (None,), ("",)]
    got = documents.unreadable(spark.createDataFrame(rows, "x string"), "x").collect()
    assert sorted(r.reason.split(":")[0] for r in got) == ["no XML", "no XML", "no text"]


def test_no_machine_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from assayflow.workspace import shared_dir

    session = lambda master, folder: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: folder), sparkContext=SimpleNamespace(master=master, applicationId="x"))
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(session("spark://host:7077", None))
    assert shared_dir(session("spark://host:7077", "hdfs://f/")) == "hdfs://f"
