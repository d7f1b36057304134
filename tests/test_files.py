"""Readers, writers, streaming, folding and design on tiny files."""

import gzip
import json

from pyspark.sql import functions as F

from bindlattice.operators import design, fold
from bindlattice.sources import files
from bindlattice.streaming import ingest


def test_sequence_files(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">M1 miRNA (let-x) Species let-x\nTGAGGTAGTAGGTTGTAT\nIGNORED\n>M2 miRNA (short) S s\nACGT\n")
    assert [tuple(r) for r in files.guides(spark, str(tmp_path / "g.fa")).collect()] == [("M1", "let-x", "UGAGGUAGUAGGUUGUAU")]
    with gzip.open(tmp_path / "t.fa.gz", "wt") as out:
        out.write(">T1.3|G|a|b|N|GENE|9|UTR5:1-2|CDS:3-6|\nACGT\nACGTT\n>T2.1|G|a|b|N|X|4|CDS:1-4|\nAAAA\n")
    r = files.transcripts(spark, str(tmp_path / "t.fa.gz"), spark.createDataFrame([("T1",)], "transcript_id string")).collect()
    assert len(r) == 1 and (r[0]["sequence"], r[0]["gene"], r[0]["utr5_start"], r[0]["cds_end"], r[0]["utr3_start"]) == ("ACGUACGUU", "GENE", 0, 5, None)
    (tmp_path / "r.fq").write_text("@a\nACNACGNA\n+\nIIIIIIII\n@b\nAA\n+\nII\n")
    assert {tuple(x) for x in files.reads(spark, str(tmp_path / "r.fq")).collect()} == {("a", "ACG"), ("b", "AA")}


def test_interval_and_annotation_files(spark, tmp_path):
    (tmp_path / "b.bg").write_text("chr1\t0\t10\t0.5\nbroken\nchr1\tx\t20\t1\nchr2\t5\t6\t1\n")
    assert files.bedgraph(spark, str(tmp_path / "b.bg")).count() == 2
    (tmp_path / "a.gtf").write_text('#c\nchr1\ts\texon\t1\t9\t.\t+\t.\tgene_name "K"; transcript_id "T1.2";\n')
    assert files.gtf(spark, str(tmp_path / "a.gtf")).select("transcript_id", "gene_name", "start").first() == ("T1", "K", 1)


def test_validated_marks_and_key_dedup(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"T1": {"ACG": [3, 5]}}))
    known = files.validated_positions(spark, str(tmp_path / "v.json"))
    marked = files.mark_validated(spark.createDataFrame([("T1", "ACG", 3, None), ("T1", "ACG", 4, None)], "trn string, gseq string, pst int, itb boolean"), known)
    assert {(r["pst"], r["itb"]) for r in marked.collect()} == {(3, True), (4, False)}


def test_stream_stores_each_key_once(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    row = {"trn": "T", "gna": "g", "pst": 1, "pen": 9, "kdv": 5.0, "den": -9.5, "odd": 1}
    (folder / "1.json").write_text("\n".join(json.dumps(row | x) for x in ({}, {"kdv": 2.0}, {"pst": 7})))
    ingest.store(ingest.read_interactions(spark, str(folder)), out, str(tmp_path / "cp")).awaitTermination()
    (folder / "2.json").write_text(json.dumps(row | {"kdv": 1.0}) + "\n" + json.dumps(row | {"pst": 8}))
    ingest.store(ingest.read_interactions(spark, str(folder)), out, str(tmp_path / "cp")).awaitTermination()
    assert {(r["position_start"], r["Kd"]) for r in spark.read.parquet(out).collect()} == {(1, 2.0), (7, 5.0), (8, 5.0)}


def test_folding_and_alignment(spark):
    energy, shape = fold.fold_one("GGGGAAAACCCC")
    assert shape == "((((....))))" and energy < -3
    assert fold.fold_one("AAAAAAA") == (0.0, ".......")
    assert fold.align_one("ACGU", "ACGU", 2, -3, -5, -1) == 8 and fold.align_one("ACGU", "AU", 2, -3, -5, -1) == 4 - 6
    pairs = fold.pairs_of(spark.createDataFrame([(1, "((.)())")], "id int, structure string"))
    assert {(r["i"], r["j"]) for r in pairs.collect()} == {(0, 6), (1, 3), (4, 5)}


def test_design(spark):
    t = spark.createDataFrame([("a", "ACGUACGUUUGGACGAAAA"), ("b", "UUACGUACGUUUGGACGAAAA"), ("c", "AAAA")], "transcript_id string, sequence string")
    found = design.grips(t, 4, 4, 10)
    assert found.where("bridge < 3 or bridge > 10").count() == 0
    need = t.where("transcript_id <> 'c'").select("transcript_id")
    kept = design.required_grips(found, need)
    assert kept.count() > 0 and kept.join(found, "grip").groupBy("grip").agg(F.countDistinct("transcript_id").alias("n")).where("n < 2").count() == 0
    made = design.antisense_candidates(spark.createDataFrame([("g", "ACGU", "GGC")], "grip string, seed4 string, supp3 string"), ["AAAAA"])
    assert 0 < made.count() <= 1024 and made.where("length(antisense) <> 21").count() == 0


def test_more_sources_and_sinks(spark, tmp_path):
    import pytest
    from bindlattice.sources import files

    (tmp_path / "k.fa").write_text(">12\nACGT\n>x\nAAAA\n")
    assert [tuple(r) for r in files.kmer_counts(spark, str(tmp_path / "k.fa")).collect()] == [("ACGU", 12)]
    (tmp_path / "d.txt").write_text("# c\nkeys: a, b\nmax = 3\n\nkeys: c\n")
    assert {r["key"]: r["values"] for r in files.design_file(spark, str(tmp_path / "d.txt")).collect()} == {"keys": ["c"], "max": ["3"]}
    chromosomes = spark.createDataFrame([("1", "ACGUACGU")], "chrom string, sequence string")
    ranges = spark.createDataFrame([(7, "1", 3, 5)], "id long, chrom string, start int, end int")
    assert files.genomic_slice(chromosomes, ranges).first()["letters"] == "GUA"
    guides = spark.createDataFrame([("g", "UGAGGUAGUAGG")], "guide_id string, sequence string")
    files.write_guides(guides, str(tmp_path / "guides"))
    assert files.guides_with_seed(spark, str(tmp_path / "guides"), "GAGGUAG").first()["guide_id"] == "g"
    hits = spark.createDataFrame([("T", "UGAGGUAG", "CDS", 12.345, 0.12345), ("T", "UGAGGUAG", "3UTR", 99.0, 0.5)], "trn string, gseq string, rgn string, kdv double, sac double")
    files.write_interactions(hits, str(tmp_path / "hits"))
    got = files.stored_interactions(spark, str(tmp_path / "hits"), "T", "GAGGUAG", 50.0, 2).collect()
    assert [(r["kdv"], r["sac"]) for r in got] == [(12.35, 0.1235)] or [(r["kdv"], r["sac"]) for r in got] == [(12.35, 0.1234)]
    assert files.stale(spark, str(tmp_path / "hits"), "2001-01-01").count() == 0
    asked = files.fetched(spark.createDataFrame([(1,), (2,)], "n long"), lambda r: {"twice": 2 * r["n"]} if r["n"] == 1 else 1 / 0)
    assert {(r["answer"], (r["error"] or "")[:4]) for r in asked.collect()} == {('{"twice": 2}', ""), (None, "Zero")}
    with pytest.raises(Exception, match="required"):
        files.conformed(spark.createDataFrame([(None, "n")], "mirna_id string, name string"), files.MIRNAS).collect()


def test_settings_of_a_request(spark):
    from bindlattice import settings

    f = settings.Filters.of_request({"minSeed": None, "maxKd": 0, "UTR5": False})
    assert (f.min_seed, f.max_kd, f.utr5, f.cds) == ("6mer", 1500.0, False, True) and f.check() == settings.ScanError.OK
    assert f.but(cds=False, utr3=False).check() == settings.ScanError.NO_REGION and settings.Filters(min_seed="9mer").check() == settings.ScanError.BAD_SEED
