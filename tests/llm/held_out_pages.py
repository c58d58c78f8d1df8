"""Pages written by hand for the tests of extraction: layouts with their main text, not made by the trainer's rules."""

import random

A = "The old bridge across the river was closed on Monday after engineers found cracks in two of its pillars, the council said."
B = "Traffic will be led through the village of Marden, which has asked for lower speed limits while the work goes on. It may take until spring."
C = "Built in 1911, the bridge carries some four thousand cars a day; it was last repaired in 1974, when its railings were replaced."
T = "Bridge closed for repairs"
NAV = "<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Sport</a></li></ul></nav>"
FOOT = "<footer><p>Copyright 2024 Marden Post</p><a href=/i>Imprint</a></footer>"
P = f"<p>{A}</p><p>{B}</p><p>{C}</p>"
TEXT = [A, B, C]


def pages():
    """Name, page and the blocks of its main text."""
    cells = "<table><tr><th>Year</th><th>Work</th></tr><tr><td>1911</td><td>Opened</td></tr><tr><td>1974</td><td>New railings</td></tr></table>"
    found = {
        "header in the article": (f"<body>{NAV}<article><header><h1>{T}</h1></header>{P}</article>{FOOT}", [T, *TEXT]),
        "named header in the article": (f"<body>{NAV}<main><article class=post><header class=entry-header><h1>{T}</h1></header>{P}</article></main>{FOOT}", [T, *TEXT]),
        "data table": (f"<body>{NAV}<article><h1>{T}</h1><p>{A}</p>{cells}<p>{B}</p><p>{C}</p></article>{FOOT}", [T, A, "Year", "Work", "1911", "Opened", "1974", "New railings", B, C]),
        "comments of another heading": (
            f"<body>{NAV}<article><h1>{T}</h1>{P}</article><section><h3>What readers say</h3><div><b>Ann</b><p>About time, it was a danger to all of us.</p></div><div><b>Joe</b><p>And who is to pay for all this, I wonder?</p></div><div><b>Kim</b><p>I cross it every day.</p></div></section>{FOOT}",
            [T, *TEXT],
        ),
        "closing div": (f"<body>{NAV}<article><h1>{T}</h1>{P}</article><div>Copyright 2024 Acme</div>", [T, *TEXT]),
        "terms": (f"<body>{NAV}<article><h1>{T}</h1><p>{A}</p><dl><dt>Length</dt><dd>210 metres between its ends</dd><dt>Width</dt><dd>Two lanes and one path</dd></dl><p>{B}</p><p>{C}</p></article>{FOOT}", [T, A, "Length", "210 metres between its ends", "Width", "Two lanes and one path", B, C]),
        "figure": (f"<body>{NAV}<article><h1>{T}</h1><p>{A}</p><figure><img src=b.jpg><figcaption>The bridge in 1950</figcaption></figure><p>{B}</p><p>{C}</p></article>{FOOT}", [T, A, "The bridge in 1950", B, C]),
        "sections": (f"<body>{NAV}<article><h1>{T}</h1><section><h2>What is known</h2><p>{A}</p></section><section><h2>What comes next</h2><p>{B}</p><p>{C}</p></section></article>{FOOT}", [T, "What is known", A, "What comes next", B, C]),
        "sidebar": (f"<body><header><p>Marden Post</p></header>{NAV}<div id=content><h1>{T}</h1>{P}</div><aside><h3>Most read</h3><ul><li><a href=1>Mill for sale</a></li><li><a href=2>School fair</a></li></ul></aside>{FOOT}", [T, *TEXT]),
        "notice and advert": (f"<body><div class=cookie-consent><p>We use cookies to make this site better.</p><button>Accept</button></div>{NAV}<main><h1>{T}</h1><p>{A}</p><div class=advert><p>Buy fresh bread at Miller's</p></div><p>{B}</p><p>{C}</p></main>{FOOT}", [T, *TEXT]),
        "form": (f"<body>{NAV}<article><h1>{T}</h1>{P}<form><label>Your address</label><button>Send me news</button></form></article>{FOOT}", [T, *TEXT]),
        "scripts": (f"<body>{NAV}<article><h1>{T}</h1><script>var a = '<p>no</p>';</script><style>p {{}}</style>{P}</article><!-- <p>no</p> -->{FOOT}", [T, *TEXT]),
        "comments in the main element": (f"<body>{NAV}<main><article><h1>{T}</h1>{P}</article><div class=comments><h2>2 comments</h2><article><p>Good riddance to that old thing.</p></article><article><p>It should be kept as it is.</p></article></div></main>{FOOT}", [T, *TEXT]),
        "list": (f"<body>{NAV}<article><h1>{T}</h1><p>{A}</p><ul><li>The north lane is closed</li><li>The path stays open</li></ul><p>{B}</p><p>{C}</p></article>{FOOT}", [T, A, "The north lane is closed", "The path stays open", B, C]),
        "quote": (f"<body>{NAV}<article><h1>{T}</h1><p>{A}</p><blockquote>We had no choice, the engineer said.</blockquote><p>{B}</p><p>{C}</p></article>{FOOT}", [T, A, "We had no choice, the engineer said.", B, C]),
        "share links": (f"<body>{NAV}<article><h1>{T}</h1>{P}<div class=share><a href=f>Share</a> <a href=m>Mail</a></div></article><div><h4>Read next</h4><ul><li><a href=1>Mill for sale</a></li></ul></div>{FOOT}", [T, *TEXT]),
    }
    return [(name, page, text) for name, (page, text) in found.items()]


def varied(seed=5, each=10):
    """The same layouts with other words, lengths of paragraphs and class names."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abdegilmnoprstuv") for _ in range(rng.randint(2, 9)))
    for name, page, text in pages():
        for _ in range(each):
            swap = {t: (" ".join(word() for _ in range(rng.randint(18, 90))).capitalize() + ".") for t in TEXT} | {T: " ".join(word() for _ in range(rng.randint(2, 8))).capitalize()}
            html = page
            for a, b in swap.items():
                html = html.replace(a, b)
            yield name, html, [swap.get(t, t) for t in text]
