import pytest
from pyspark.sql import functions as F

from quillspark.llm import markup, sentences


@pytest.mark.parametrize("text, families", [
    ("Plain a < b and b > c, p_value, 4 * 3 * 2, C#, issue #3, R&D, $40, about ~20, [12], x | y.", []), ("A &amp; b", ["html"]), ("a<br/> b", ["html"]), ("# Head\n\ntext", ["markdown"]), ("a **b** c", ["markdown"]),
    ("== H ==\nx", ["wiki"]), ("[[A|b]]{{cn|date=1}}", ["wiki"]), ("''it''", ["wiki"]), ("``Quoted,'' he said", ["latex"]), (r"Nusr{\`e}navo", ["latex"]), ("K.~X (1999)", ["latex"]), ("{Braced} title", ["latex"]),
    ("$x_1$ is", ["latex"]), ("```py\nx_y_z <b>\n```", ["markdown"]), (r"\begin{itemize}\item a & b\end{itemize}", ["latex"]), ("'''b <b>c'''</b>", ["html", "wiki"]), (None, []), ("", []),
])
def test_families(text, families):
    assert markup.clean(text)[1] == families


def test_rendering():
    html = "<html><head><title>T</title><style>x{}</style></head><body><h1>Head</h1><p>One<p>Two <b>bold</b><ul><li>a<li>b<ol><li>c</ol></ul><pre>x  =\n  1</pre><!-- no --><div hidden>gone</div><table><tr><th>n<th>value<tr><td>long one<td>2</table>"
    assert markup.clean(html, True)[0] == "Head\n\nOne\n\nTwo bold\n\n- a\n- b\n  1. c\n\nx  =\n  1\n\nn         value\nlong one  2"
    tex = "\\documentclass{a}\\title{T}\\begin{document}\\section{S {x}}% no\nText \\emph{it}~\\cite{k} $a_b$.\\label{l}\n\\begin{equation}\nE=m\\label{e}\n\\end{equation}\\begin{tabular}{ll}a & bb \\\\ ccc & d\\end{tabular}\\begin{verbatim}\n%x\n\\end{verbatim}\\end{document}"
    assert markup.clean(tex, True) == ("T\n\nS x\n\nText it [k] a_b.\n\nE=m\n\na    bb\nccc  d\n\n%x", ["latex"])
    assert markup.clean("= a =\n{| class=\"w\"\n|-\n| x || 1\n|}\n* one\n** two\n[[Category:C]]", True)[0] == "= a =\n\nx  1\n\n- one\n  - two"
    assert markup.clean("| a | b |\n|---|---|\n| 1 | 2 |")[0] == "a  b\n1  2"
    assert markup.clean("No format *here*_", True) == ("No format *here*_", [])


def test_cleaning_columns(spark):
    df = spark.createDataFrame([(1, "<b>x</b>"), (2, None), (3, "")], "id bigint, t string").withColumn("clean", F.lit("clash"))
    assert {(r.id, r.clean, tuple(r.families)) for r in markup.clean_texts(df, "id", "t").collect()} == {(1, "x", ("html",)), (2, None, ()), (3, "", ())}
    assert markup.clean_texts(df.limit(0), "id", "t").count() == 0


@pytest.mark.parametrize("text, parts", [
    ("Mr. L. Smith saw Fig. 3 at 9.30 a.m. by foot. He left, e.g. Table 1 vs. Table 9, etc. Then it rained!", ["Mr. L. Smith saw Fig. 3 at 9.30 a.m. by foot.", "He left, e.g. Table 1 vs. Table 9, etc.", "Then it rained!"]),
    ('He said: "One is it? Two is more." Next. “Odd!” was the reply of no. 2. (All of this.) End', ['He said: "One is it? Two is more."', "Next.", "“Odd!” was the reply of no. 2.", "(All of this.)", "End"]),
    ("Am 8. März kam Nr. 1945. Am 7. ging es, z. B. so.", ["Am 8. März kam Nr. 1945.", "Am 7. ging es, z. B. so."]),
    ("他说：「结果不对。」于是重做了50次！见图2.2，误差约为7（8）。“为什么？”他问道。", ["他说：「结果不对。」于是重做了50次！", "见图2.2，误差约为7（8）。", "“为什么？”他问道。"]),
    ("«Это неверно.» — ответил он. См. рис. 6 и стр. 3, т. е. всё. Да", ["«Это неверно.» — ответил он.", "См. рис. 6 и стр. 3, т. е. всё.", "Да"]),
    ("¿Por qué? El Dr. X usa aprox. 3, p. ej. la fig. 2. Sí.", ["¿Por qué?", "El Dr. X usa aprox. 3, p. ej. la fig. 2.", "Sí."]),
    ("नई विधि है। डॉ. X आया।", ["नई विधि है।", "डॉ. X आया।"]), ("ผลลัพธ์คงที่ ชั้นบาง? แบบจำลอง", ["ผลลัพธ์คงที่", "ชั้นบาง?", "แบบจำลอง"]),
    ("Line one\nwraps here. Two\n\nblank breaks", ["Line one\nwraps here.", "Two", "blank breaks"]), ("1) First one. Still\n- Second\n\\item Third\nText.", ["1) First one. Still", "- Second", "\\item Third", "Text."]),
    ("open.The next", ["open.", "The next"]), ("  \n\t ", []), ("", []), ("v1.2.3 of x.py", ["v1.2.3 of x.py"]),
])
def test_sentences(text, parts):
    spans = sentences.sentence_spans(text)
    assert [text[a:b] for a, b in spans] == parts


def test_sentence_columns(spark):
    df = spark.createDataFrame([(1, "A b. C d."), (2, None), (3, " "), (4, "x " * 50_000)], "element_no bigint, t string").withColumn("start_pos", F.lit(9))
    got = {tuple(r) for r in sentences.split_sentences(df, "element_no", "t").collect()}
    assert got == {(1, 0, 4), (1, 5, 9), (4, 0, 99_999)}


def test_deep_long_and_unclosed_markup():
    import time

    deep = "a " + r"\textbf{<b>\emph{" * 200 + "core" + "}</b>}" * 200 + " z"
    clean, families = markup.clean(deep)
    assert clean.startswith("a") and "core" in clean and clean.endswith("z") and not any(x in clean for x in ("\\", "{", "<b>")) and families == ["html", "latex"]
    late = "Plain words. " * 500 + "<p>One</p> and <div>two &amp; three</div>"
    assert markup.clean(late, True)[1] == ["html"] and "two & three" in markup.clean(late, True)[0]
    assert markup.clean(r"x \footnote[" + "o" * 900 + "]{gone} y")[0] == "x (gone) y"
    assert markup.clean("``" + "q" * 900 + "''")[1] == ["latex"]
    assert markup.clean("<ul>loose <li>one</li></ul>")[0] == "loose\n- one"
    for mark in (r"\begin{equation} x ", r"\[ x ", "$$ x ", "`` ", "{| ", "<!"):
        t = time.time()
        markup.clean(mark * 8000)
        assert time.time() - t < 6, mark
