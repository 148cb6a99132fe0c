"""A few hand-labelled pages, from which extraction learns what words and tags weigh.

Everything between [[ and ]] is main text; the brackets are no part of a page.
"""

PAGES = [
    """<html><head><title>River works</title></head><body><header><a href="/">Gazette</a><p>Daily news for the valley</p></header>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">Sport</a></li><li><a href="/c">Weather</a></li></ul></nav>
<article>[[<h1>River works begin</h1><p>Crews closed the northern bank on Monday to rebuild the wall that failed in spring.</p>
<p>The council expects the work to take <b>nine weeks</b>, and asks walkers to use the <a href="/m">marked path</a>.</p>]]</article>
<aside><h3>Most read</h3><ul><li><a href="/1">Bridge opens</a></li><li><a href="/2">Fair returns</a></li></ul></aside>
<footer><p>Contact us at the office in Mill Street.</p></footer></body></html>""",
    """<html><body><div class="cookie-notice"><p>We use cookies to improve this site.</p><button>Accept</button></div>
<div id="menu"><a href="/x">Start</a> <a href="/y">Archive</a> <a href="/z">About</a></div>
<div id="content">[[<h2>How bread rises</h2><p>Yeast eats sugar and gives off gas. The gas fills small pockets in the dough.</p><blockquote>Warm kitchens make quick bread.</blockquote>
<ul><li>Mix flour and water.</li><li>Wait until it doubles.</li></ul>]]</div>
<div class="comments"><h3>2 comments</h3><p>Ann: mine never rises, what can I do about it?</p><p>Bob: try fresher yeast next time.</p></div>
<form><p>Leave a reply</p><textarea></textarea></form></body></html>""",
    """<html><body><table><tr><td><a href="/">index</a><br><a href="/n">next</a></td><td>[[<p>The lamp keeper climbed the stairs each evening at six, counted the oil, and wrote the number down.</p>
<p>In forty years he missed two nights.</p><p>Both were stormy.</p>]]</td></tr></table><div class="ad">Buy lamps now at half the price, only today.</div></body></html>""",
    """<html><body><main>[[<h1>Field notes</h1><p>Larks nest in the short grass. We counted eleven pairs this year, two more than last.</p><pre>north 4
south 7</pre><h2>Method</h2><p>One walk each week, at dawn, along the same line.</p>]]
</main><section class="related"><h2>Related</h2><p><a href="/p">Owls in barns</a></p><p><a href="/q">Swifts in towns</a></p></section>
<div class="newsletter"><p>Subscribe for weekly letters from the field.</p></div></body></html>""",
    """<html><body><ul class="breadcrumb"><li><a href="/">Top</a></li><li><a href="/g">Guides</a></li></ul><div class="sidebar"><p>Popular guides</p><p><a href="/s">Salt</a></p></div>
<div class="post">[[<h1>Sharpening a plane iron</h1><p>Begin with the back. It needs to be flat only near the edge.</p><p>Then hold the bevel to the stone and draw it towards you.</p><p>Stop when you feel a burr.</p>]]</div>
<div class="share"><a href="#">Share</a><a href="#">Print</a></div><div class="footer">All rights reserved by the guild of joiners.</div></body></html>""",
]
