"""Pages written apart from the training fragments, in the manner of common site builders; marks enclose their main text."""

PAGES = [
    # A blog theme with a masthead, a widget area and a comment form.
    """<!doctype html><html><head><title>Bees</title><link rel=stylesheet href=a.css></head><body class="post-template">
<header class="site-header"><p class="site-title"><a href="/">The Hive</a></p><nav class="main-navigation"><ul><li><a href="/about">About</a></li><li><a href="/shop">Shop</a></li></ul></nav></header>
<div id="primary"><article class="hentry"><!--main--><h1 class="entry-title">Keeping bees on a balcony</h1><div class="entry-content"><p>Last spring I carried two wooden hives up four flights of stairs, and my neighbours asked whether I had lost my mind.</p>
<p>By August there were nine jars of dark honey on the kitchen table. The bees had found the lime trees in the park, <a href="/trees">as bees do</a>, and came home heavy.</p><h2>What you need</h2><ul><li>A hive with two boxes, and a stand that keeps it off the floor.</li><li>A smoker, gloves, and patience.</li></ul><p>Start small.</p></div><!--/main--></article>
<div id="comments"><h3>3 thoughts</h3><ol class="comment-list"><li><p>Wonderful story, I had the same trouble with my neighbours last year.</p></li><li><p>How much honey did they need for the winter?</p></li></ol><form id="commentform"><p>Leave a reply</p><label>Name</label><input></form></div></div>
<aside id="secondary" class="widget-area"><section class="widget"><h2>Recent posts</h2><ul><li><a href="/1">Wax</a></li><li><a href="/2">Swarms in May</a></li></ul></section></aside>
<footer class="site-footer"><p>Powered by a theme. All rights reserved.</p></footer></body></html>""",
    # A newspaper page with plain divs, a teaser list and a consent box.
    """<html><body><div id="cookie-banner"><p>This site uses cookies to make your visit better, to measure use and to show adverts that fit.</p><button>Accept all</button></div>
<div class="topbar"><a href="/login">Sign in</a> <a href="/sub">Subscribe</a></div><div class="menu"><a href="/w">World</a><a href="/b">Business</a><a href="/s">Sport</a></div>
<div class="story-body"><!--main--><h1>Ferry line to close after ninety years</h1><p>The last ferry between the two harbours will leave on Sunday evening, the company said, ending a service that began in 1931.</p><p>Passenger numbers fell by half in ten years. "We tried everything," said the director, "but the tunnel is faster and cheaper."</p><blockquote>It was never only a ship; it was the village square.</blockquote><p>Workers will be offered posts at the port.</p><!--/main--></div>
<div class="related"><h4>More stories</h4><ul><li><a href="/n1">Tunnel tolls to rise in autumn</a></li><li><a href="/n2">Port plans a new crane</a></li></ul></div><div class="ad-slot">Advert: holidays by the lake from 99 a week.</div>
<div class="footer"><a href="/imprint">Imprint</a> | <a href="/privacy">Privacy</a> | &copy; Harbour News</div></body></html>""",
    # Documentation: main element, code, a table, breadcrumbs and a sidebar.
    """<html><body><header><a href=/>Docs</a><form role="search"><input placeholder=Search><button>Search</button></form></header><div class="breadcrumb"><a href=/>Home</a> / <a href=/cli>Tools</a> / Copy</div>
<nav class="sidebar"><ul><li><a href=/a>Install</a><li><a href=/b>Configure</a><li><a href=/c>Copy</a></ul></nav><main><!--main--><h1>Copying files</h1><p>The command copies a file or a whole folder to another place; it asks before it overwrites anything.<pre>copy --recursive from to</pre><table><tr><th>Option<td>Meaning<tr><td>-f<td>Overwrites without asking, so use it with care.</table><p>Links are kept as they are, unless you say otherwise.<!--/main--></main>
<footer><p>Was this page helpful? <button>Yes</button> <button>No</button></p></footer></body></html>""",
    # A page in German of bare paragraphs in one section, with a share bar.
    """<html lang=de><body><ul class="nav"><li><a href="/">Startseite</a></li><li><a href="/termine">Termine</a></li></ul><section class="article"><!--main--><h2>Neue Orgel für die Stadtkirche</h2><p>Nach zwölf Jahren Planung ist die neue Orgel fertig: Am Samstag erklingt sie zum ersten Mal im Gottesdienst.</p><p>Rund 2.400 Pfeifen wurden eingebaut, die größte davon misst fast fünf Meter. Die Kosten trugen vor allem Spender aus der Gemeinde.</p><p>Der Eintritt zum Konzert am Abend ist frei, um Spenden wird gebeten.</p><!--/main--></section>
<div class="social"><a href="/s1">Teilen</a> <a href="/s2">Merken</a></div><div class="newsletter"><p>Bleiben Sie auf dem Laufenden und bestellen Sie unseren Newsletter.</p><form><input><button>Bestellen</button></form></div><footer>&copy; Stadtkirche &middot; Impressum</footer></body></html>""",
    # A recipe with notices and a promoted box inside the article.
    """<html><body><nav><a href="/">Kitchen</a> <a href="/soups">Soups</a></nav><div class="alert notice"><p>We are moving: please update your bookmarks before June.</p></div><article><!--main--><h1>Onion soup</h1><p>Slice six onions thinly and let them cook in butter until they are brown and sweet, which takes longer than you think.</p><!--/main--><div class="promo"><p>Our cookbook is out now: order it today and save ten percent.</p></div><!--main--><p>Add the stock and a little wine, and simmer for half an hour. Serve with toasted bread and cheese.</p><ol><li>Onions first, slowly.</li><li>Then the stock, all at once.</li></ol><!--/main--></article><section class="comments"><h2>Comments</h2><div class="comment"><p>I added thyme and it was even better.</p></div></section><footer><p>Contact us | Terms</p></footer></body></html>""",
    # Malformed: unclosed paragraphs and bold text, upper-case tags, stray brackets.
    """<HTML><BODY><DIV CLASS=header><A HREF="/">River Post</A></DIV><ARTICLE><!--main--><H1>Flood watch</H1><P><B>Water stood at 4 metres on Monday, less than in 2013, when levels of > 6 metres were read at the old gauge.<P>Farmers moved their animals to higher ground, and schools in three villages stayed closed.<P>The river is expected to fall by Thursday.<!--/main--></ARTICLE><FOOTER>&copy; River Post""",
]
