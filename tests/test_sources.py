import pytest
from pyspark.sql import functions as F

from ringweave.sources import gfa, reports, sequences, tables

GFA = """H\tVN:Z:1.0
# a comment
S\t1\tACGTGG\tKC:i:12\tRC:i:3
S\t2\t*\tLN:i:40\tdp:f:1.5
S\t3\t*
L\t1\t+\t2\t-\t5M\tMQ:i:7
L\t2\t-\t1\t+\t*\tMQ:i:9
L\t3\t+\t3\t+\t20M1I34M
C\t1\t-\t2\t+\t10\t4M\tRC:i:2
P\tp1\t1+,2-\t5M
X\tother
"""


def test_gfa(spark, tmp_path, rows):
    (tmp_path / "s1.gfa").write_text(GFA)
    lines = gfa.read_lines(spark, str(tmp_path))
    got = {r.seg_name: (r.sample_id, r.length, r.depth, round(r.gc, 3), r.read_count) for r in gfa.segments(lines).collect()}
    assert got == {"1": ("s1", 6, 2.0, 0.667, 3), "2": ("s1", 40, 1.5, 0.0, None), "3": ("s1", None, None, 0.0, None)}
    assert rows(gfa.links(lines), "from_seg", "to_seg", "overlap_length", "map_quality") == [("1", "2", 5, 7), ("2", "1", 0, 9), ("3", "3", 0, None)]
    assert rows(gfa.link_tags(gfa.links(lines)), "a", "b", "map_quality") == [("1", "2", 9), ("3", "3", None)]
    assert rows(gfa.containments(lines), "container", "container_ori", "pos", "read_count", "differences") == [("1", "-", 10, 2, None)]
    assert rows(gfa.paths(lines), "path", "step", "segment", "orientation") == [("p1", 1, "1", "+"), ("p1", 2, "2", "-")]


def test_fasta(spark, tmp_path, rows):
    (tmp_path / "a.fasta").write_text(">x1 some text\r\nACG\r\nT-\n>x2\n\n>y_component_3\nGG\n>z_component_3\nGG\n")
    df = sequences.read_fasta(spark, str(tmp_path / "a.fasta"))
    assert rows(df, "id", "description", "seq") == [("x1", "some text", "ACGT-"), ("x2", "", ""), ("y_component_3", "", "GG"), ("z_component_3", "", "GG")]
    assert rows(sequences.record_counts(spark, str(tmp_path / "a.fasta"))) == [("a.fasta", 4)]
    assert rows(sequences.component_counts(df.filter("id like '%component%'"))) == [("a.fasta", 1)]
    out = str(tmp_path / "out")
    sequences.write_fasta(df, out, head="id", seq="seq")
    sequences.write_fasta(df.limit(1), out, head="id", seq="seq", append=True)
    assert sequences.read_fasta(spark, out).count() == 5


GENBANK = """LOCUS       REC1   20 bp
FEATURES             Location/Qualifiers
     source          1..20
     gene            2..5
                     /locus_tag="L1"
     gene            complement(1..4)
                     /gene="abc"
     gene            join(1..2,
                     5..6)
                     /note="none"
ORIGIN
        1 acgttgcaac ggttaaccgg
//
LOCUS       REC2   4 bp
FEATURES             Location/Qualifiers
     source          1..4
ORIGIN
        1 aaaa
//
"""


def test_genbank(spark, tmp_path, rows):
    (tmp_path / "r.gb").write_text(GENBANK)
    got = rows(sequences.read_genbank(spark, str(tmp_path)), "record", "record_length", "gene_no", "gene_id", "seq")
    assert got == sorted([("REC1", 20, 0, "L1", "CGTT"), ("REC1", 20, 1, "gene1_abc", "ACGT"), ("REC1", 20, 2, None, "ACTG"), ("REC2", 4, None, None, "AAAA")], key=repr)


def test_tables(spark, tmp_path, rows):
    (tmp_path / "h.tsv").write_text("g\tc\t99.5\t10\t0\t0\t1\t10\t20\t11\t1e-5\t50\ng\tc\t90\t9\t0\t0\tNA\t10\t20\t11\t0.1\t5\n")
    hits = tables.read_hits(spark, str(tmp_path / "h.tsv"))
    assert rows(hits, "qseqid", "pident", "qstart", "sstart") == [("g", 90.0, None, 20), ("g", 99.5, 1, 20)]
    tables.write_hits(hits, str(tmp_path / "out"))
    assert rows(tables.read_hits(spark, str(tmp_path / "out")).drop("hit_id")) == rows(hits.drop("hit_id"))
    (tmp_path / "l.txt").write_text("a \n\nb\n")
    assert tables.read_list(spark, str(tmp_path / "l.txt")).count() == 2 and tables.read_list(spark, str(tmp_path / "l.txt"), keep_blank=True).count() == 3
    (tmp_path / "bins.csv").write_text("p1,p2\np3\n")
    assert rows(tables.read_bins(spark, str(tmp_path / "bins.csv")), "bin", "member") == [("bin_0", "p1"), ("bin_0", "p2"), ("bin_1", "p3")]
    bins = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (0, 1, "c")], "bin_no int, place int, member string")
    tables.write_bins(bins, str(tmp_path / "binned"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "binned")).collect()) == ["a,b", "c"]
    (tmp_path / "s.csv").write_text("Id;Name\n01;x\n")
    assert rows(tables.read_delimited(spark, str(tmp_path / "s.csv"))) == [("01", "x")]
    assert tables.read_delimited(spark, str(tmp_path / "s.csv"), header=False, columns=["a", "b"]).count() == 2


REPORT = """##### general information #####
number of reference chromosomes: 1
\tC1: 900 nt
number of reference plasmids: 2
\tR2: 50 nt
\tR1: 100 nt

##### tool (tool) #####
number of predicted plasmids: 2
\tP a: 40 nt
\tPb: 60 nt

> predicted plasmid covers <proportion> of reference plasmid
\tR1\tR2
P a\t0.25\t0.0
Pb\t0.5\t1.0

> reference plasmid covers <proportion> of predicted plasmid
\tP a\tPb
R1\t0.75\t0.1
R2\t0.0\t0.9

> in total, how much of predicted plasmid is covered by reference plasmids
plasmid\tproportion
P a\t0.750000
Pb\t1.000000

> in total, how much of reference plasmid is covered by predicted plasmids
plasmid\tproportion
R1\t0.700000
R2\t1.000000

> pairs of predicted and reference plasmids with coverage >= 0.800000 in both directions
R2 <-> Pb (1.000000 resp. 0.900000)

> summary scores (tool)
recall: 0.800000
score_pred_coverage: 0.9
f1_score: 0.85

##### tool (questionable) #####
number of predicted plasmids: 1
\tQ: 9 nt

> summary scores (questionable)
recall: 0.1
"""
EMPTY = """number of reference plasmids: 1
\tR1: 100 nt
number of predicted plasmids: 0

> predicted plasmid covers <proportion> of reference plasmid
\tR1

> pairs of predicted and reference plasmids with coverage >= 0.800000 in both directions
none

> summary scores (tool)
recall: 0
"""


def test_reports(spark, tmp_path, rows):
    (tmp_path / "e.csv").write_text(REPORT)
    (tmp_path / "f.csv").write_text(EMPTY)
    sections = reports.read_sections(spark, str(tmp_path)).cache()
    refs, preds, pairs = reports.load_scores(sections)
    assert rows(refs) == [("e.csv", "R1", 100, 0.5, 0.7), ("e.csv", "R2", 50, 1.0, 1.0), ("f.csv", "R1", 100, 0.0, 0.0)]
    assert rows(preds) == [("e.csv", "P a", 40, 0.75, 0.75), ("e.csv", "Pb", 60, 0.9, 1.0)]
    assert rows(pairs) == [("e.csv", "R2", "Pb", 1.0, 0.9)]
    assert rows(reports.plasmids(sections, "chromosomes")) == [("e.csv", "C1", 900)]
    assert rows(reports.summary(sections).filter("file = 'e.csv'"), "score", "value") == [("overall", 0.85), ("precision", 0.9), ("recall", 0.8)]
    sections.unpersist()


def test_quality(spark, tmp_path, rows):
    (tmp_path / "q1.tsv").write_text("Assembly\tgreedy\tother\n# misassemblies\t2\t0\n    # relocations\t1\t-\n")
    (tmp_path / "q2.tsv").write_text("Assembly\tother\n# misassemblies\t5\n")
    report = reports.read_quality(spark, str(tmp_path))
    files = spark.createDataFrame([("q1.tsv",), ("q2.tsv",), ("q3.tsv",)], "file string")
    got = rows(reports.quality_of(report, files, "greedy", ["misassemblies", "relocations"]))
    assert got == [("q1.tsv", 2.0, 1.0, False), ("q2.tsv", 0.0, 0.0, True), ("q3.tsv", 0.0, 0.0, True)]
    assert rows(report.filter(F.col("value") == "-"), "metric", "tool") == [("relocations", "other")]
