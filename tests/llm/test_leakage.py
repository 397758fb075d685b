"""Leaked passages against a search over all runs of letters."""

import random
import unicodedata

from weftline.llm import leakage

ITEMS = [
    (1, "en", "Which of the following best explains why Dreolo chose to mend the gilded quarry in Heskondo although Veso Fennordell had already promised the staircase to Gralundo Studios for 4 weeks?"),
    (2, "en", "According to the summary of Zelelbeth Tollgate, the nimble quarry found by Mira Oskelndo near Kestudunmouth belonged to Stenartine, whose hollow staircase had been sold in 1975 together with 49 mirrors."),
    (3, "zh", "根据《第九座仓库》的梗概，为什么祁砚明知邬澜汐早已把古怪的摄影机许给澜光影业整整10个星期，仍然决定在青澜镇展示那件安静的摄影机？"),
    (4, "de", "Warum musste Heskulo nach der Zusammenfassung von Stenequist Orchard die schräge Kulisse in Tamorskaholm zeigen, obwohl Silo Briarbeth die Straße schon im März 1988 an Gralara Studios verliehen hatte?"),
    (5, "en", None),
]


def normal(text):
    text = unicodedata.normalize("NFKD", text or "").casefold()
    return "".join(c for c in text if unicodedata.category(c)[0] in "LN")


def contains(doc, item):
    _, lang, text = item
    k, a, b = (24 if lang in ("zh", "ja") else 60), normal(doc), normal(text)
    runs = {b[i : i + k] for i in range(len(b) - k + 1)}
    return any(a[i : i + k] in runs for i in range(len(a) - k + 1))


def test_passages(spark):
    rng = random.Random(1)
    docs = []
    for _, _, text in ITEMS[:4]:
        words = text.split() if " " in text else list(text)
        glue = " " if " " in text else ""
        for n in (4, 8, 12, 16, 24, 40, 60):
            at = rng.randint(0, max(0, len(words) - n))
            part = glue.join(words[at : at + n])
            for form in (part, part.upper(), part.replace("a", "a­").replace("的", "的​"), "\n".join(part.split(" ")), part.replace("e", "е")):
                docs.append("The harness stayed. “" + form + "” And so on.")
    docs += [None, "", " \n ", ITEMS[0][2] + " " + ITEMS[2][2], "x" * 200_000 + ITEMS[1][2], unicodedata.normalize("NFD", ITEMS[3][2]).replace("ß", "ss")]
    rows = [(i, d, "clash") for i, d in enumerate(docs)] + [(0, docs[0], "clash")]
    df = spark.createDataFrame(rows, "doc long, text string, item string")
    items = spark.createDataFrame(ITEMS, "item long, lang string, text string")
    got = {(r["doc"], r["item"]) for r in leakage.leaked_passages(df, items).collect()}
    want = {(i, it[0]) for i, d in enumerate(docs) for it in ITEMS[:4] if contains(d, it)}
    assert got == want
    assert leakage.leaked_passages(df, items.limit(0)).collect() == [] == leakage.leaked_passages(df.limit(0), items).collect()


PROBES = [
    (10, "en", "the caretaker of the old picture house kept every torn ticket in a tin box under the stairs until spring"),
    (11, "de", "Donaudampfschifffahrtsgesellschaftskapitän Rindfleischetikettierungsüberwachungsaufgaben Kraftfahrzeughaftpflichtversicherung"),
    (12, "en", "Anna Berghaus, Peter Oluwaseun Adeyemi, Maria Castellanos Ruiz, Johann Friedrich Wellenreuther, Fatima Haddad"),
]


def test_word_division_does_not_matter(spark):
    """Blanks removed, words broken over lines, hyphens, compounds, runs of names, other numbers of blanks, very long texts."""
    a, b, c = (t for _, _, t in PROBES)
    forms = [
        (a, 10), (a.replace(" ", ""), 10), ("Well. " + a.replace("er", "e-\nr") + "!", 10), (a.replace(" ", "-"), 10), (b, 11), (c, 12),
        ("\n" * 30 + a.upper().replace(" ", " \u200b \n\n "), 10), ("y " * 700_000 + c.replace(" ", "") + " z" * 300_000, 12), (" ".join(b), 11),
    ]
    near = [a[:60].replace(" ", ""), c.replace("e", "a"), None]
    docs = [(i, t) for i, (t, _) in enumerate(forms)] + [(100 + i, t) for i, t in enumerate(near)]
    items = spark.createDataFrame(PROBES + ITEMS, "item long, lang string, text string")
    docs = spark.createDataFrame(docs, "doc long, text string")
    assert {(r["doc"], r["item"]) for r in leakage.leaked_passages(docs, items).collect()} == {(i, x) for i, (_, x) in enumerate(forms)}


def test_random_cuts_against_brute_force(spark):
    """Runs just below, at and above the least length, in letters, digits and characters, whatever the groups of texts."""
    rng = random.Random(11)
    alphabet = "abcdefgh0123456789 .,-éßﬁ½" + "电影年9"
    items = [(i, rng.choice(["en", "zh", "ja", None]), "".join(rng.choice(alphabet) for _ in range(rng.choice([10, 70, 300])))) for i in range(30)]
    docs = []
    for i in range(300):
        _, _, text = rng.choice(items)
        a = rng.randint(0, max(0, len(text) - 20))
        part = text[a : a + rng.choice([20, 24, 30, 55, 66, 80, 120])]
        docs.append((i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) + part + "".join(rng.choice(alphabet) for _ in range(9))))
    got = leakage.leaked_passages(spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame(items, "item long, lang string, text string"))
    assert {(r["doc"], r["item"]) for r in got.collect()} == {(d, it[0]) for d, t in docs for it in items if contains(t, it)}


def test_long_texts_in_groups():
    groups = list(leakage._grouped([1, 2, 3, 4], ["a" * 10, "b" * leakage.CHARS_AT_ONCE, "c", "d"]))
    assert [g[0] for g in groups] == [[1], [2], [3, 4]]


def test_reparameterised(spark):
    asked = "Which of the following best explains why Mavarro chose to mend the gilded quarry in Pellemar although Tova Ilvindo had already promised the staircase to Wexister Studios for 59 weeks?"
    docs = spark.createDataFrame([(1, asked), (2, ITEMS[0][2]), (3, "Nothing of the kind.")], "doc long, text string")
    items = spark.createDataFrame(ITEMS[:1], "item long, lang string, text string")
    got = {r["doc"]: r for r in leakage.leaked_templates(docs, items).collect()}
    assert {d: r["kind"] for d, r in got.items()} == {1: "reparameterised", 2: "copied"}
    assert got[1]["changed"] > 0 == got[2]["changed"]
