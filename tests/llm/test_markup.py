import pytest

from lumenfold.llm import markup as m

MARKED = ["<p>Some text.</p>", "a &nbsp;b", "it&#8217;s", "an **important** thing", "see [here](http://x.example)", "# Title\n\ntext", "Title\n=====\ntext", "```\ncode\n```", "a [[link]] b", "{{cn}}", "== H ==", "'''bold'''", r"\section{A}", r"$\alpha \le 2$", r"need~\cite{x}", "<b>unclosed", "text</p> more", "![i](a.png)", "~~gone~~", "&lt;p&gt;x&lt;/p&gt;", "{| class=x\n|-\n| a || b\n|}"]
PLAIN = ["A load with x < 3 and y > 4 is fine.", "Paid $35 for a and $4 for b.", r"Look in D:\new\alpha first.", "Issue #95 covers it.", "Rating: *** out of five.", "The product 5 * 3 * 2 is big.", "by <a.b@c.example> last week", "R&D & Sons (C# tools)", "file_name_12.txt", "Note -- the dialog == the template; ~12 pages.", "Reference [3] (see also [4]).", "Ports -> a => b", "fill {cursor} here", "Vec<u8> and Option<usize>", "", "plain"]


@pytest.mark.parametrize("t", MARKED)
def test_constructs_are_met(t):
    assert sum(m.clean(t)[1].values()) > 0


@pytest.mark.parametrize("t", PLAIN)
def test_plain_text_is_left_alone(t):
    assert m.clean(t) == (t, {"html": 0, "markdown": 0, "wiki": 0, "latex": 0})


def test_html_structure():
    t = '<nav><a href="/">Home</a> <a href="/b">Other pages of the site</a></nav><div><h2>Head</h2><p>First, long paragraph, with commas, and text.</p><ul><li>one<li>two</ul><pre>x = 1\ny</pre></div><script>var a;</script>'
    got = m.clean(t)[0]
    assert "## Head" in got and "- one" in got and "- two" in got and "```\nx = 1\ny\n```" in got
    assert "Home" not in got and "var a" not in got and "<" not in got


def test_markdown_wiki_latex_structure():
    assert m.clean("Head\n---\n\n> a **b** [c](d)\n\n* x\n* y")[0] == "## Head\n\na b c\n\n- x\n- y"
    assert m.clean("==Head==\nA [[P|b]] '''c'''<ref name=\"a\">d</ref>.\n[[Category:X]]")[0].startswith("## Head\nA b c")
    got = m.clean(r"\section{Head}\label{a} A \textbf{b} \$5 $x^2$ \begin{itemize}\item c\end{itemize}")[0]
    assert "## Head" in got and "A b $5 $x^2$" in got and "- c" in got and "\\" not in got


def test_source_and_long_and_nested():
    assert m.clean("# comment\n<b>x</b>", source=True)[0] == "# comment\n<b>x</b>"
    long = "<div>" * 300 + "word, " * 20000 + "</div>" * 300
    assert len(m.clean(long)[0]) > 100_000
    assert m.clean("<div><p>" * 20_000 + "word" + "</p></div>" * 20_000)[0] == "word"
    for hostile in ("<a " * 20_000, "[" * 20_000, "{{" * 10_000, "*" * 50_000, "$" * 20_001, "\\begin{" * 5_000, "&" * 50_000, "<!--" * 5_000):
        m.clean(hostile)


def test_table(spark):
    rows = [(1, "<b>x</b>", None, 9), (1, "<b>x</b>", None, 9), (2, "plain", None, 9), (3, None, None, 9), (4, "", None, 9), (5, "# c", "f", 9)]
    df = spark.createDataFrame(rows, "id long, text string, symbol string, constructs int")
    from pyspark.sql import functions as F

    assert {r.id for r in m.marked_ids(df, "id", "text", F.col("symbol").isNotNull()).collect()} == {1}
    got = {r.id: (r.clean_text, r.constructs) for r in m.clean_table(df, "id", "text", F.col("symbol").isNotNull()).collect()}
    assert got[1] == ("x", 2) and got[2] == ("plain", 0) and got[3] == (None, 0) and got[4] == ("", 0) and got[5] == ("# c", 0)
    assert m.clean_table(df.limit(0), "id", "text").count() == 0


def test_nothing_is_lost_to_damage():
    rest = "\n\nSecond paragraph, with text.\n\nThird paragraph."
    assert m.clean("Use the `<script>` tag in a page." + rest)[0] == "Use the `<script>` tag in a page." + rest
    assert "Third paragraph." in m.clean("Cut <svg> icon then go on." + rest)[0] and "icon then go on" in m.clean("Cut <svg> icon then go on." + rest)[0]
    for name in ("script", "style", "template", "iframe"):
        assert "Third paragraph." in m.clean(f"<p>a</p><{name}>" + rest)[0]
    assert "hidden" not in m.clean("<p>a</p><script>hidden()</script><p>b</p>")[0]
    assert m.clean("before <!-- open" + rest)[0] == "before  open" + rest
    fence = 'Text **b**\n\n```html\n<div class="a"><b>bold</b></div>\n```\n\nmore'
    assert m.clean(fence)[0] == 'Text b\n\n```\n<div class="a"><b>bold</b></div>\n```\n\nmore'


def test_nesting_to_any_depth():
    assert m.clean(r"\textbf{\textit{\emph{\underline{\textsf{\texttt{deep er}}}}}} end")[0] == "deep er end"
    assert m.clean("{{a|{{b|{{c|{{d|inner}}}}}}}} end")[0] == "inner end"
    assert m.clean("\\textbf{" * 3000 + "x" + "}" * 3000)[0] == "x"
    assert m.clean("{{t|" * 3000 + "x" + "}}" * 3000)[0] == "x"
    assert m.clean(r"\textbf{open to the end")[0] == "open to the end"
    assert m.clean("text \x00 and **b**")[0] == "text \x00 and b"


def test_comments_of_source_are_read():
    source = "// see <b>this</b> &amp; [that](https://x.example)\nint a = b<c>::d(**e); // a*b"
    got, n = m.clean(source, source=True)
    assert got == "// see this & that\nint a = b<c>::d(**e); // a*b" and sum(n.values()) == 4
    assert m.clean("# a list\n# - x\ndef f(**kw): return kw['a'][0]  # TODO", source=True)[1] == {"html": 0, "markdown": 0, "wiki": 0, "latex": 0}
