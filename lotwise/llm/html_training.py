"""Labelled pages for the HTML extraction model: hand-written pieces, composed into whole pages in many layouts.

Comments <!--main--> and <!--/main--> enclose what is main text; labels are read from them and features are not. Main text has
short lists, links, tables, captions and headings as well as paragraphs, and notices stand within it as well as around it.
"""

from __future__ import annotations

import random

_LONG = (
    "The council met on Tuesday to discuss the new bridge, which will join the two banks of the river by next spring.",
    "According to the engineers, the first pillars are ready; the second row has been delayed because of high water, rain and frost in the valley. Work goes on, they said, and nobody expects the costs to rise.",
    "Nobody was hurt.",
    "Prices rose by 4.2 percent in March, after 3.9 percent in February. Economists had expected less, and several of them now believe that rates will stay where they are until autumn, when new figures on wages, rents and energy are due.",
    "Why does it matter? Because the old mill, built in 1871, is the last of its kind.",
    "Das Museum zeigt ab Freitag rund achtzig Bilder, darunter einige, die noch nie zu sehen waren. Der Eintritt ist frei.",
    "Les pluies de la semaine ont coupé deux routes, et les habitants du village attendent encore le retour du courant.",
    "El equipo ganó el partido en los últimos minutos, con un gol que pocos esperaban y que todos celebraron.",
    "It took three years", "He said: \"We tried everything.\"", "More than 400 people came to the opening, most of them on foot.",
)
_SHORT = ("A bridge for two towns", "Prices up again", "The old mill", "Was bleibt", "Après la pluie", "Salt", "Two ropes", "Guide to the valley", "Map", "12 May", "Olive oil, 2 spoons", "Part one")
#: Pieces of main text: {a} is a sentence or more, {s}, {t} and {u} are short.
_MAIN = (
    "<p>{a}</p>", "<p>{a}</p>", "<p>{a}</p><p>{b}</p>", "<p><b>{a}<br><p>{b}</p>", "<p>{a}<p>{b}", "<div>{a}</div>", "<h2>{s}</h2><p>{a}</p>", "<h3>{s}</h3><div>{a}</div>", "<p>{s}</p>",
    "<ul><li>{s}<li>{t}<li>{u}</ul>", "<ul><li>{s}</li><li>{a}</li><li>{b}</li></ul>", "<ol><li>{t}</li><li>{u}</li><li>{s}</li></ol><p>{a}</p>", "<p><a href='/g'>{s}</a></p>", "<p><a href='/g'>{a}</a></p>",
    "<p>{a} <a href='/x'>{s}</a> {b}</p>", "<p>See <a href='/x'>{s}</a>.</p>", "<ul><li><a href='/1'>{s}</a></li><li><a href='/2'>{t}</a></li></ul><p>{a}</p>", "<blockquote>{a}</blockquote>", "<blockquote><p>{a}</p></blockquote>",
    "<pre>{a}</pre>", "<table><tr><th>{s}</th><th>{t}</th></tr><tr><td>{u}</td><td>{a}</td></tr></table>", "<table><tr><td>{s}<td>{t}<tr><td>{u}<td>7</table>", "<figure><img src=i><figcaption>{s}</figcaption></figure>",
    "<figure><figcaption>{a}</figcaption></figure><p>{b}</p>", "<dl><dt>{s}</dt><dd>{a}</dd><dt>{t}</dt><dd>{u}</dd></dl>", "<details><summary>{s}</summary><p>{a}</p></details>", "<section><h2>{s}</h2><p>{a}</p></section>",
)
_HEAD = ("<h1>{s}</h1>", "<h1>{s}</h1><p>{a}</p>", "<h2>{s}</h2>", "<h1>{a}</h1>", "")
_FRAMES = (
    "<article>{m}</article>", "<main>{m}</main>", "<div class='content'>{m}</div>", "<div id='article-body' class='post entry'>{m}</div>", "<main><article class='story'>{m}</article></main>",
    "<section class='article text'>{m}</section>", "<div><div>{m}</div></div>", "{m}", "<article class='post'><div class='entry-content'>{m}</div></article>",
)
_TOP = (
    "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li><li><a href='/c'>and, more</a></li></ul></nav>", "<nav><a href='/a'>{s}</a> <a href='/b'>{t}</a></nav>",
    "<header><h1>{s}</h1><p>{t}</p></header><nav><a href='/a'>Home</a> <a href='/b'>Sport</a></nav>", "<header class='site-header'><a href='/'>{s}</a></header>",
    "<div class='header masthead top'><div class='logo brand'>{s}</div></div><div class='menu navbar navigation'><a href='/a'>Home</a><a href='/b'>World</a></div>", "<div id='menu'><a href='/a'>{s}</a><a href='/b'>{t}</a></div>",
    "<ul class='nav menu topnav'><li><a href='/a'>Start</a></li><li><a href='/b'>Kontakt</a></li></ul><div class='breadcrumb breadcrumbs'><a href='/'>Home</a> &gt; {s}</div>", "<div class='topbar'><a href='/in'>{s}</a></div>",
    "<div class='search searchbox'><form><input type=text><button>Go</button></form></div><nav role='navigation'><a href='/a'>{s}</a></nav>", "",
)
#: Words of class or id that alone mark a notice, advert, teaser or tool, and the ways in which these are written.
_NOISY = (
    "ad ads advert advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification announcement alert warning popup modal overlay sidebar widget side rail share social"
    " sharing toolbar related recommended more teaser newsletter subscribe subscription signup login account user paywall disclaimer message flash tags meta byline breadcrumb pagination pager"
).split()
_BOXES = (
    "<div class='{w}'>{a}</div>", "<div class='{w}'><p>{a}</p></div>", "<div class='{w}'>We use cookies to measure use. <a href='/p'>More</a></div>", "<div class='{w} box'><h3>{s}</h3><p>{a}</p></div>", "<p class='{w}'>{a}</p>",
    "<div class='{w}'><a href='/p'>{a}</a></div>", "<div id='{w}'><ul><li><a href='/1'>{s}</a></li><li><a href='/2'>{t}</a></li></ul></div>", "<section class='{w}'><h4>{s}</h4><p>{t}</p></section>", "<ul class='{w}'><li>{s}</li><li>{t}</li></ul>",
    "<aside><h3>{s}</h3><p>{a}</p></aside>", "<aside>{a}</aside>", "<form action='/s'><label>{s}</label><p>{a}</p><input><select><option>{t}</option></select><button>{u}</button></form>", "<div role='alert'>{a}</div>", "<noscript><p>{a}</p></noscript>",
    "<nav><a href='/1'>{s}</a> <a href='/2'>{t}</a></nav>", "<dialog><p>{a}</p><button>OK</button></dialog>", "<button>{s}</button>", "<div class='{w}'><form><p>{a}</p><input><button>{s}</button></form></div>",
)
_AFTER = (
    "<section class='comments'><h2>Comments</h2><div class='comment'><p>{a}</p></div><div class='comment'><p>{b}</p></div></section>",
    "<div id='comments' class='comment-list discussion'><ol><li><cite>{s}</cite><p>{b}</p></li><li><p>{a}</p></li></ol></div>",
    "<div class='reader responses reply replies thread feedback disqus'><article class='comment'><p>{a}</p></article></div>", "<div id='comments'><p>{a}</p><p>{b}</p></div>",
    "<ul class='commentlist'><li>{b}</li><li>{a}</li></ul>", "<div class='pagination pager'><a href='/2'>2</a> <a href='/3'>3</a></div>", "<div class='replies'><p>{a}</p></div>", "", "",
)
_BOTTOM = (
    "<footer>&copy; news.example &middot; {a}</footer>", "<footer><p>{a}</p><ul><li><a href='/i'>Imprint</a></li></ul></footer>", "<footer><p>{s}</p></footer>", "<div class='footer'><a href='/i'>{s}</a></div>",
    "<div class='footer bottom legal copyright'><p>&copy; 2020 {a}</p></div>", "<div id='footer' role='contentinfo'><a href='/i'>Contact</a> {a}</div>", "",
)
MARK, UNMARK = "<!--main-->", "<!--/main-->"


def labelled_pages(per_frame: int = 36, seed: int = 17) -> list[str]:
    """Pages that compose pieces at random, so many for each frame of the main text, frame after frame; always the same."""
    rng = random.Random(seed)

    def filled(piece: str, word: str = "") -> str:
        short = rng.sample(_SHORT, 3)
        return piece.format(a=rng.choice(_LONG), b=rng.choice(_LONG), s=short[0], t=short[1], u=short[2], w=word)

    def box() -> str:
        return filled(rng.choice(_BOXES), rng.choice(_NOISY))

    pages = []
    for frame in _FRAMES:
        for _ in range(per_frame):
            parts = [filled(rng.choice(_HEAD)), *(filled(rng.choice(_MAIN)) for _ in range(rng.randrange(2, 9)))]
            for _ in range(rng.choice((0, 0, 1, 2))):
                parts.insert(rng.randrange(1, len(parts) + 1), f"{UNMARK}{box()}{MARK}")
            within = f"{UNMARK}{filled(rng.choice(_AFTER))}" if frame != "{m}" and rng.random() < 0.2 else UNMARK
            body = frame.format(m=f"{MARK}{''.join(parts)}{within}")
            boxes = ["".join(box() for _ in range(rng.randrange(3))) for _ in range(2)]
            whole = f"{filled(rng.choice(_TOP))}{boxes[0]}{body}{filled(rng.choice(_AFTER))}{boxes[1]}{filled(rng.choice(_BOTTOM))}"
            whole = f"<div id='page' class='wrapper container'>{whole}</div>" if rng.random() < 0.25 else whole
            pages.append(f"<html><head><title>{rng.choice(_SHORT)}</title></head><body>{whole}</body></html>")
    return pages
