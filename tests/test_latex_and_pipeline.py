import json

from pyspark.sql import functions as F

from quillspark import sources
from quillspark.operators import export as X, hierarchy as H, latex as L
from quillspark.operators.ordering import row_numbers
from quillspark.plans import pipeline
from quillspark.plans.timing import Phases
from quillspark.sources import sinks

MAIN = r"""\documentclass{article}
\title{A {Nested} Title}\author{Ann}\begin{document}\maketitle
\begin{abstract}We test.\end{abstract}
\section{One {a}} Dr. Smith saw it. \cite{k1} He left. \input{sec/a}
\subsection{Two} $$x=1$$ \begin{itemize}\item first \item second\end{itemize} % hidden
\Section{Three} \input{sec/a} \input{gone}
\end{document}"""


def write(folder):
    v = folder / "2401-00001" / "tex" / "v1"
    (v / "sec").mkdir(parents=True)
    (v / "figures").mkdir()
    (v / "main.tex").write_text(MAIN)
    (v / "sec" / "a.tex").write_bytes(b"Included \xff text.")
    (v / "response.tex").write_text(r"\documentclass{article}\begin{document}x\end{document}")
    (v / "main.bib").write_text("@article{k1, title = {A Study of Very Small Things}, year = {2001}}\n@misc{k2, title={not cited}}")
    (folder / "2401-00001" / "references.json").write_text(json.dumps({"0101.1": {"title": "A study of very small things", "authors": "One", "submissionDate": "2001-02-03"}, "0101.2": {"title": "Other", "authors": ["B"], "year": "1999"}}))


def test_pipeline(spark, tmp_path):
    write(tmp_path / "raw")
    c = pipeline.Config(str(tmp_path / "raw"), str(tmp_path / "out"))
    assert pipeline.run(spark, c) == {"processed": 1, "matched": 1}
    t = pipeline.process(spark, c)
    flat = t["flat"].first()
    assert flat.root_file_path == "main.tex" and flat.metadata.merged_files == ["sec/a.tex"] and flat.metadata.missing_files == ["gone"]
    assert "Included  text." in flat.content and "Circular dependency" in flat.content and "hidden" not in flat.content
    assert [r.key for r in t["refs"].collect()] == ["k1"]
    heads = {r.title: (r.pos, r.parent_pos, r.level) for r in t["headers"].collect()}
    assert heads == {"Root": (0, None, 0), "One {a}": (1, 0, 3), "Two": (2, 1, 4), "Three": (3, 0, 3)}
    kinds = [r.type for r in t["blocks"].filter("pos = 2").orderBy("block_no").collect()]
    assert kinds == ["equation", "list", "list_item", "list_item"]
    edges = {(r.child_id.split("-v1-")[1], r.parent_id.split("-v1-")[1]) for r in t["edges"].collect()}
    assert {("h1", "h0"), ("h2", "h1"), ("h3", "h0"), ("title", "h0"), ("abstract", "h0"), ("h2-b0", "h2"), ("h2-b2", "h2-b1")} <= edges
    h = json.loads(spark.read.text(f"{tmp_path}/out/hierarchy").first().value)
    assert set(h) == {"hierarchy", "elements"} and h["hierarchy"]["1"]["2401-00001-v1-h2"] == "2401-00001-v1-h1" and h["elements"]["2401-00001-v1-title"] == "A {Nested} Title"
    assert {r.file_name for r in spark.read.text(f"{tmp_path}/out/metadata").collect()} == {"references.json"}
    assert pipeline.run_matching(spark, c) == 1
    some = pipeline.select_papers(sources.raw_files(spark, c.raw), "2402")
    assert some.count() == 0 and pipeline.select_papers(sources.raw_files(spark, c.raw), "2401", 0, 5, 3).count() == 4
    assert pipeline.arguments().parse_args(["--range", "2", "9", "-w", "4"]).range == [2, 9]
    label = sources.labels(spark, f"{tmp_path}/out/labels").collect()
    assert len(label) == 1 and label[0].ground_truth.id == "0101.1" and label[0].ground_truth.match_score == 1.0
    refs = sources.refs_bib(spark, [f"{tmp_path}/out/refs_bib/*/*"], r"paper_id=([^/]+)/").collect()
    assert refs[0].paper_id == "2401-00001" and refs[0].raw_text.startswith("@article{k1")


def test_equal_content_has_one_id(spark):
    text = r"\section{One} Same sentence here. New one. \section{Two} Same sentence here."
    docs = spark.createDataFrame([("p", "v1", text), ("p", "v2", r"\section{One} Same sentence here. Other."), ("p", "v3", None)], "paper_id string, version string, content string")
    edges, elements = H.hierarchy(H.assemble(docs, ["paper_id", "version"]))
    e = {(r.version_num, r.child_id, r.parent_id) for r in edges.collect()}
    assert ("1", "p-v1-h1-b0", "p-v1-h2") in e and ("2", "p-v1-h1-b0", "p-v2-h1") in e and not any("h2-b0" in c for _, c, _ in e)
    assert {r.content for r in elements.collect()} == {"Root", "One", "Two", "Same sentence here.", "New one.", "Other."}
    assert H.assemble(docs.limit(0), ["paper_id", "version"]).count() == 0
    assert H.preview(H.assemble(docs.filter("version = 'v1'"), ["paper_id", "version"]), 3) == ["[document] Root", "  [section] One", "    [sentence] Same sentence here."]


def test_phases():
    t = Phases()
    for name in ("a", "b", "a"):
        with t.phase(name):
            pass
    assert [x[0] for x in t.report(4)] == ["a", "b", "total"] and Phases().report() == [("total", 0, 0.0, 0.0)]


def test_row_numbers_of_a_hot_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k"), F.expr("id * 7919 % 5000").alias("o"))
    got = {}
    for r in row_numbers(df, ["k"], ["o"], "n").collect():
        got.setdefault(r.k, []).append((r.n, r.o))
    for rows in got.values():
        rows.sort()
        assert [n for n, _ in rows] == list(range(len(rows))) and [o for _, o in rows] == sorted(o for _, o in rows)


def test_headers_and_blocks():
    assert L.find_headers(None) == [("document", False, "Root", "")]
    assert L.find_headers(r"a \section*{B {c}} d \part{never closed")[1:] == [("section", True, "B {c}", " d "), ("part", False, "never closed", "")]
    assert L.sentences("See e.g. Test one. Dr. Smith left! (Then) he came.") == ["See e.g. Test one.", "Dr. Smith left!", "(Then) he came."]
    assert L.content_blocks("")== [] and L.content_blocks("% <BEGIN_FILE: a>\nHi there.")[0][2] == "Hi there."


def test_cleaning(spark):
    df = spark.createDataFrame([(r"\textbf{a \emph{b}} $\alpha$ \footnote{gone} \centering c \% d % rest",)], "t string")
    assert df.select(L.clean_latex(F.col("t"))).first()[0] == r"a b $\alpha$ c \% d"
    eq = spark.createDataFrame([(r"\[ x \label{e} = 1 \nonumber\]",)], "t string").select(L.clean_equation(F.col("t"))).first()[0]
    assert eq == "\\begin{equation}\nx = 1\n\\end{equation}"


def test_versions_and_sinks(spark, tmp_path):
    v = spark.createDataFrame([("p", "v10"), ("p", "v2")], "paper_id string, version string")
    assert {r.version: r.ver_ord for r in sources.versions(v).collect()} == {"v2": 1, "v10": 2}
    assert {r.version: r.ver_ord for r in sources.versions(v, numeric=False).collect()} == {"v10": 1, "v2": 2}
    ranked = spark.createDataFrame([("p", "test", "k", 2, "b"), ("p", "test", "k", 1, "a")], "paper_id string, partition string, key string, rank int, cand_id string")
    truth = spark.createDataFrame([("p", "k", "a")], "paper_id string, key string, true_id string")
    sinks.predictions_json(ranked, truth, f"{tmp_path}/pred")
    got = json.loads(next((tmp_path / "pred" / "paper_id=p").glob("*.txt")).read_text())
    assert got == {"partition": "test", "groundtruth": {"k": "a"}, "prediction": {"k": ["a", "b"]}}
    art = spark.createDataFrame([("p", "refs.bib", "x"), ("p", "labels.json", "y"), ("q", "refs.bib", "z")], "paper_id string, file_name string, value string")
    assert sinks.package(ranked, art, f"{tmp_path}/pkg", dry_run=True) == (1, 2)
    assert sinks.merged(truth, truth).count() == 2


def test_export(spark):
    h = spark.createDataFrame([("p", "1", "s", "doc", 1), ("p", "1", "x", "s", 2), ("p", "1", "l", "s", 3), ("p", "1", "i", "l", 4)], "paper_id string, version_num string, child_id string, parent_id string, edge_no int")
    e = spark.createDataFrame([(1, "p", "s", "section", "Head", 3, None), (2, "p", "x", "sentence", "T", 99, "Text <1>."), (3, "p", "l", "list", "List", 99, None), (4, "p", "i", "list_item", "I", 99, "one")], "element_no int, paper_id string, element_id string, node_type string, title string, level int, content string")
    n = X.ordered_nodes(h, e)
    text = {f: X.export(n, f).first().text for f in ("markdown", "html", "latex")}
    assert text["markdown"] == "### Head\n\nText <1>.\n\n- one\n"
    assert "<p>Text &lt;1&gt;.</p>" in text["html"] and "<ul><li>one</li>" in text["html"]
    assert text["latex"] == "\\section{Head}\nText <1>.\n\\begin{itemize}\n\\item one\n\\end{itemize}\n"
    assert json.loads(X.nodes_and_edges(n).first().json)["metadata"] == {"total_nodes": 4, "total_edges": 4}
