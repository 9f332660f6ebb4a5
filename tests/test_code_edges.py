"""Edges out of code: every way to read, write, name and call."""

from pyspark.sql import functions as F

from trestle.operators import acquire

FIELDS = ["ffs", "spl", "lane_width", "shoulder_width", "followers_density", "avg_speed", "los", "capacity"]
CODE = """
impl Demo {
    pub fn new(spl: f64) -> Self { self.ffs = spl; }
    pub fn determine_ffs(&mut self, seg_num: usize) {
        let v = self.base(seg_num) + self.segments[seg_num].get_spl();
        if v > 1.0 { self.segments[seg_num].set_ffs(v); }
    }
    fn base(&self, i: usize) -> f64 { self.lw + self.get_spl() + self.shoulder_width * self.local }
    pub fn find_los(&self, fd: f64, mut s_pl: f64) -> char { 'A' }
    pub fn find_none_los(&mut self, x: f64) { self.capacity /= 2.0; }
    pub fn grow(&mut self, spl: &Map<String, f64>) { self.capacity = self.capacity + self.ffs_adj; self.ffs == 1.0; }
    pub fn set_all(&mut self, spl: f64) { self.ffs = spl; }
    fn open(&self) { {
"""


def flows(spark, known=FIELDS, **how):
    f = acquire.functions_of(spark.createDataFrame([(1, CODE), (2, None), (3, "")], "id int, c string"), ["id"], "c")
    return {r.name: (r.reads, r.writes) for r in acquire.dataflow(f, ["id"], known, **how).collect()}


def test_reads_and_writes(spark):
    f = flows(spark)
    assert set(f) == {"new", "determine_ffs", "base", "find_los", "find_none_los", "grow", "set_all"}  # what isn't closed is no function
    assert f["determine_ffs"] == (["lane_width", "shoulder_width", "spl"], ["ffs"])  # its helper's reads, too
    assert f["base"] == (["lane_width", "shoulder_width", "spl"], [])
    assert f["find_los"] == (["avg_speed", "followers_density"], ["los"])  # aliases of arguments; the output by the name
    assert f["find_none_los"] == ([], ["capacity"])  # it writes, so its name says nothing
    assert f["grow"] == (["ffs", "spl"], ["capacity"])  # what is assigned isn't read; == assigns nothing


def test_a_known_name_stands_for_itself(spark):
    assert flows(spark, [*FIELDS, "lw"])["base"][0] == ["lw", "shoulder_width", "spl"]
    assert flows(spark, aliases={})["base"][0] == ["shoulder_width", "spl"]
    assert flows(spark, suffixes={})["find_los"][1] == []
    assert flows(spark, [x for x in FIELDS if x != "los"])["find_los"][1] == []


def test_vocabularies_by_facility(spark):
    code = spark.createDataFrame([(1, CODE, "a"), (2, CODE, "b")], "id int, c string, facility string")
    words = spark.createDataFrame([("a", FIELDS), ("b", ["ffs", "spl"])], "facility string, fields array<string>")
    f = acquire.functions_of(code, ["id", "facility"], "c").join(words, "facility")
    got = {(r.facility, r.name): r.reads for r in acquire.dataflow(f, ["id", "facility"], F.col("fields")).collect()}
    assert got["b", "determine_ffs"] == ["spl"] and got["a", "determine_ffs"] == ["lane_width", "shoulder_width", "spl"]


def test_edges_of_steps_only(spark):
    out = acquire.code_edges(spark.createDataFrame([(1, CODE)], "id int, c string"), ["id"], "c", FIELDS).collect()
    assert {(r.src, r.dst, r.name, r.line) for r in out} == {
        ("lane_width", "ffs", "determine_ffs", 4), ("shoulder_width", "ffs", "determine_ffs", 4), ("spl", "ffs", "determine_ffs", 4),
        ("followers_density", "los", "find_los", 9), ("avg_speed", "los", "find_los", 9), ("ffs", "capacity", "grow", 11), ("spl", "capacity", "grow", 11),
    }
    assert {(r.type, r.origin, r.status) for r in out} == {("AFFECTS", "code_derived", "candidate_unaudited")}
    assert acquire.code_edges(spark.createDataFrame([], "id int, c string"), ["id"], "c", FIELDS).count() == 0


def test_the_last_of_equal_names_counts(spark):
    twice = "fn f_a(spl: f64) { self.set_ffs(1); }\nfn f_a(lw: f64) { self.set_ffs(1); }"
    out = acquire.code_edges(spark.createDataFrame([(1, twice)], "id int, c string"), ["id"], "c", FIELDS).collect()
    assert [(r.src, r.dst, r.line) for r in out] == [("lane_width", "ffs", 2)]


def test_callees_are_never_broadcast(spark, tmp_path):
    spark.createDataFrame([(1, CODE)], "id int, c string").write.parquet(f"{tmp_path}/code")
    out = acquire.code_edges(spark.read.parquet(f"{tmp_path}/code"), ["id"], "c", FIELDS)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 7
