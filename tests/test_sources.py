"""Files in, files out."""

import gzip
import random

import pytest

from seqloom.operators.clusters import derep_map, derep_map_problems, parsed
from seqloom.operators.config import FilterConfig, parse_options
from seqloom.operators.derep import key_length
from seqloom.operators.pipeline import demultiplexed
from seqloom.sources import fastx, maps


def records(n=300):
    r = random.Random(4)
    out = []
    for k in range(n):
        size = r.randint(1, 60)
        out.append((f"r{k}", "".join(r.choice("ACGTN") for _ in range(size)), "".join(r.choice("@+>I#5") for _ in range(size))))
    return out


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("size", ["100", "1000", "100000"])
def test_fastq_ranges(spark, tmp_path, end, size):
    rows = records()
    path = tmp_path / "a.fastq"
    path.write_bytes("".join(f"@{h} 1:N:0{end}{s}{end}+{end}{q}{end}" for h, s, q in rows).encode())
    got = fastx.read_fastx(spark, str(path), rangebytes=size).orderBy("read_ord").collect()
    assert [(r.read_id, r.sequence, r.quality) for r in got] == rows
    assert {r.qual_offset for r in got} == {33}


@pytest.mark.parametrize("size", ["50", "100000"])
def test_fasta(spark, tmp_path, size):
    path = tmp_path / "a.fa"
    path.write_bytes(b"\xef\xbb\xbf>a x\nACG\nTT\n>b\n>c\nac\n")
    got = fastx.read_fastx(spark, str(path), rangebytes=size).orderBy("read_ord").collect()
    assert [(r.read_id, r.sequence) for r in got] == [("a", "ACGTT"), ("b", ""), ("c", "AC")]


def test_several_files_gzip_and_limit(spark, tmp_path):
    rows = records(20)
    text = "".join(f"@{h}\n{s}\n+\n{q}\n" for h, s, q in rows)
    (tmp_path / "a.fq").write_text(text)
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write(text)
    got = fastx.read_fastx(spark, [str(tmp_path / "a.fq"), str(tmp_path / "b.fq.gz")])
    assert got.count() == 40 and got.select("read_ord").distinct().count() == 40
    assert fastx.read_fastx(spark, str(tmp_path), firstreads="3").count() == 6


def test_broken_record(spark, tmp_path):
    path = tmp_path / "a.fq"
    path.write_text("@a\nAC\n+\nII\n@b\nAC\n+\nI\n@c\nGG\n+\nII\n")
    assert [r.read_id for r in fastx.read_fastx(spark, str(path), mode="DROPMALFORMED").collect()] == ["a", "c"]
    with pytest.raises(Exception, match="broken"):
        fastx.read_fastx(spark, str(path)).collect()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_broken_record_in_ranges(tmp_path, end):
    path = tmp_path / "a.fq"

    def ids(size, mode):
        reader = fastx.FastxReader({"path": str(path), "rangebytes": str(size), "mode": mode, "fileformat": "fastq"})
        return [x for part in reader.partitions() for batch in reader.read(part) for x in batch.column("read_id").to_pylist()]

    sound = [f"@r{k}{end}{s}{end}+{end}{q}{end}" for k, (_, s, q) in enumerate(records(12))]
    for size in (7, 40, 90, 250, 10_000):
        path.write_text("".join(sound), newline="")
        assert ids(size, "FAILFAST") == [f"r{k}" for k in range(12)]
        path.write_text((end * 30).join(sound), newline="")
        assert ids(size, "FAILFAST") == [f"r{k}" for k in range(12)]
        for k in range(12):
            for broken in (f"@r{k}{end}ACG{end}+{end}II{end}", f"r{k}{end}ACG{end}+{end}III{end}", f"@r{k}{end}ACG{end}"):
                path.write_text("".join([*sound[:k], broken, *sound[k + 1 :]]), newline="")
                with pytest.raises(ValueError, match="broken"):
                    ids(size, "FAILFAST")
                assert ids(size, "DROPMALFORMED") == [f"r{i}" for i in range(12) if i != k]


def test_offsets():
    assert fastx.detect_offset("@x 1:N:0", "hhhh") == 33
    assert fastx.detect_offset("@x", "##II") == 33
    assert fastx.detect_offset("@x", "hhhh") == 64
    assert fastx.detect_offset("@x", "BBBB") == 33
    with pytest.raises(ValueError):
        fastx.sniff(b"x")


def test_qual(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">a\nACG\n>b\nAC\n")
    (tmp_path / "a.qual").write_text(">a x\n1 2\n3\n")
    got = fastx.with_quality(fastx.read_fastx(spark, str(tmp_path / "a.fa")), fastx.read_qual(spark, str(tmp_path / "a.qual")))
    assert {r.read_id: r.scores for r in got.collect()} == {"a": [1, 2, 3], "b": [11, 11]}


def test_sample_map(spark, tmp_path):
    path = tmp_path / "m.txt"
    path.write_text("#SampleID\tOdd\tBarcodeSequence\tderepMin\nS1\tx\tacgt\t3\nS2\ty\t\t\n")
    got = maps.read_sample_map(spark, str(path)).orderBy("sample_idx").collect()
    assert [(r.sample_id, r.barcode_sequence, r.derep_min) for r in got] == [("S1", "ACGT", 3), ("S2", None, None)]
    path.write_text("#SampleID\tBarcodeSequence\nS1\n")
    with pytest.raises(ValueError):
        maps.read_sample_map(spark, str(path))


def test_options():
    c = parse_options(["minSeqLength\t200", "*minSeqLength 120", "# x", "", "minAvgQuality\t27.5", "RejectSeqWithoutFwdPrim\tT"])
    assert (c.min_length, c.min_length_2, c.min_quality, c.need_forward_primer) == (200, 120, 27.5, True)
    assert parse_options([]) == FilterConfig()
    with pytest.raises(ValueError):
        parse_options(["nonsense 1"])


@pytest.mark.parametrize(("line", "field"), [("PEheaderPairFmt 1", "pair_format"), ("AmpliconShortPE T", "short_amplicon")])
def test_options_not_implemented(line, field):
    with pytest.raises(ValueError, match=line.split()[0]):
        parse_options([line])
    assert parse_options([line.split()[0] + " 0"]) == FilterConfig()
    with pytest.raises(ValueError, match="not implemented"):
        demultiplexed(None, None, FilterConfig(**{field: 1}))


def test_options_of_pairs():
    """Mixed mates can be told in pairs only; asking for it elsewhere is an error and not ignored."""
    config = parse_options(["CheckForMixedPairs T", "ExtensivePrimerChecks T", "CheckForReversedSeqs T"])
    assert config.check_mixed_pairs and config.extensive_primers and config.check_reversed
    with pytest.raises(ValueError, match="demultiplexed_pairs"):
        demultiplexed(None, None, config)


def test_options_of_keys_and_offsets(spark):
    assert [key_length(parse_options(x)) for x in (["derepSrchLen 30"], ["derepSrchLen -1"], ["minSeqLength 200"], ["minSeqLength 0"])] == [30, -1, 200, 150]
    samples = spark.createDataFrame([(0, "S0", "AACC", None, None)], "sample_idx int, sample_id string, barcode_sequence string, forward_primer string, reverse_primer string")
    reads = spark.createDataFrame([("AACCGTGTGTGT", "h" * 12, 33, 1)], "seq string, quality string, qual_offset int, mate int")
    offsets = [demultiplexed(reads, samples, parse_options(x), quality_filter=False).first().qual_offset for x in ([], ["fastqVersion 1"], ["fastqVersion 2"], ["fastqVersion 3"])]
    assert offsets == [33, 33, 64, 59]


LINES = {
    "uc": ["H\t0\t250\t98.4\t+\t0\t0\t=\tr1\to1", "S\t0\t250\t*\t.\t*\t*\t*\to1\t*"],
    "vsearch": ["S\t0\t250\t*\t.\t*\t*\t*\to1\t*", "H\t0\t250\t98.4\t+\t0\t0\t=\tr1\to1"],
    "uparse8": ["o1\totu\t*\t*\t*", "r1\tmatch\t98.4\t+\to1"],
    "uparse9": ["o1;size=9;\totu1\t*", "r1;size=2;\tmatch\tdqt=1;top=o1;(98.4%)"],
    "unoise": ["o1;size=9;\tdenoise\tamp1;top=o1;", "r1;size=2;\tdenoise\ttop=o1;"],
    "cdhit": [">Cluster 0", "0\t250nt, >o1... *", "1\t250nt, >r1... at +/98.40%"],
    "paf": ["r1\t250\t0\t250\t+\to1\t250\t0\t250\t246\t250\t60"],
}


@pytest.mark.parametrize("dialect", LINES)
def test_cluster_maps(spark, dialect):
    lines = spark.createDataFrame(list(enumerate(LINES[dialect])), "line_no int, line string")
    got = {r.query.split(";")[0]: (r.target, r.identity) for r in parsed(lines, dialect).collect()}
    assert got["r1"][0].rstrip(";") == "o1"
    assert got["r1"][1] == pytest.approx(98.4) or dialect == "unoise"


def test_derep_map(spark):
    lines = spark.createDataFrame([(0, "#SMPLS\t0:S0\t1:S1"), (1, "r1;size=5;\t0:2\t1:3"), (2, "r2;size=4;\t1:3")], "line_no int, line string")
    named, occ = derep_map(lines)
    assert sorted(map(tuple, named.collect())) == [(0, "S0"), (1, "S1")]
    assert sorted((r.query, r.idx, r.n) for r in occ.collect()) == [("r1", 0, 2), ("r1", 1, 3), ("r2", 1, 3)]
    assert [r.query for r in derep_map_problems(occ).collect()] == ["r2"]


def test_offset_of_a_long_first_record(spark, tmp_path):
    """The offset comes from the first whole record, however long, after blanks of any number."""
    path = tmp_path / "a.fq"
    for size in (600, 6000, 70_000):
        path.write_text("\n" * size + f"@a\n{'A' * size}\n+\n{'h' * size}\n@b\nA\n+\nB\n")
        got = fastx.read_fastx(spark, str(path)).collect()
        assert [(r.read_id, len(r.sequence), r.qual_offset) for r in got] == [("a", size, 64), ("b", 1, 64)]


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
@pytest.mark.parametrize("block", [1, 2, 7, 64, 1 << 20])
def test_compressed_in_blocks(tmp_path, monkeypatch, end, block):
    monkeypatch.setattr(fastx, "BLOCK", block)
    rows = records(40)
    with gzip.open(tmp_path / "a.fq.gz", "wb") as f:
        f.write(("".join(f"{end}@{h}{end}{s}{end}+{end}{q}{end}" for h, s, q in rows)).encode())
    with gzip.open(tmp_path / "b.fa.gz", "wb") as f:
        f.write(b"\xef\xbb\xbf" + "".join(f">{h}{end}{s[:9]}{end}{s[9:]}{end}" for h, s, _ in rows).encode())

    def read(name, **options):
        reader = fastx.FastxReader({"path": str(tmp_path / name), **options})
        return [x for part in reader.partitions() for batch in reader.read(part) for x in batch.to_pylist()]

    assert [(r["read_id"], r["sequence"], r["quality"]) for r in read("a.fq.gz")] == rows
    assert [(r["read_id"], r["sequence"]) for r in read("b.fa.gz")] == [(h, s) for h, s, _ in rows]
    with gzip.open(tmp_path / "c.fq.gz", "wb") as f:
        f.write(f"@a{end}A{end}+{end}I{end}junk{end}@b{end}C{end}+{end}I".encode())
    assert [r["read_id"] for r in read("c.fq.gz", mode="DROPMALFORMED")] == ["a", "b"]
    with pytest.raises(ValueError, match="broken"):
        read("c.fq.gz")


def test_mates_of_files(spark, tmp_path):
    """R1,index,R2 by commas, inputs by semicolons; mates are joined by their ids."""
    for name, ids in (("x1", "abc"), ("xi", "abc"), ("x2", "cba"), ("y1", "ad"), ("y2", "a")):
        (tmp_path / name).write_text("".join(f"@{i} {name[1]}:N:0:\n{name[1].replace('i', 'G').replace('1', 'AC').replace('2', 'TT')}\n+\n{'I' * (1 + (name[1] != 'i'))}\n" for i in ids))
    p = {n: str(tmp_path / n) for n in ("x1", "xi", "x2", "y1", "y2")}
    got = fastx.read_mates(spark, f"{p['x1']},{p['xi']},{p['x2']};{p['y1']},{p['y2']}").orderBy("input", "stem").collect()
    assert [(r.input, r.stem, r.r1 and r.r1.seq, r.r2 and r.r2.seq, r.index_read and r.index_read.seq) for r in got] == [
        (0, "a", "AC", "TT", "G"), (0, "b", "AC", "TT", "G"), (0, "c", "AC", "TT", "G"), (1, "a", "AC", "TT", None), (1, "d", "AC", None, None)]
    with pytest.raises(Exception, match="three files"):
        fastx.read_fastx(spark, ",".join(p.values())).collect()


def test_folder_of_a_cluster():
    """A machine's own folder is only taken in local sessions."""
    from seqloom.session import shared_dir

    class Conf(dict):
        def set(self, key, value):
            self[key] = value

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
    Session.conf = Conf({"spark.master": "spark://host:7077", "spark.checkpoint.dir": "hdfs://x/y/"})
    assert shared_dir(Session()) == "hdfs://x/y"
