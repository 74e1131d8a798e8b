"""Pages written by hand after common site layouts, with their main text; no pattern is
shared with the maker that the default field is trained on."""

PAGES = [
    # a weblog
    (
        """<html><head><title>Bread - My Kitchen</title></head><body class="home-page"><div id="page-wrap"><div id="site-header"><a class="logo" href="/">My Kitchen</a><p class="tagline">Cooking since 2009</p></div>
<div id="nav"><a href="/">Home</a> | <a href="/about">About</a> | <a href="/c">Contact</a></div>
<div class="post hentry"><h2 class="entry-title">How I bake bread</h2><div class="entry-meta">Posted on May 3 by Ana</div><div class="entry-content">
<p>Flour, water, salt and time are all you need for a good loaf.</p><p>Mix the flour with <em>lukewarm</em> water and let it rest for an hour before you add the salt.</p>
<h3>Baking</h3><ul><li>Heat the oven to 240 degrees.</li><li>Bake for forty minutes.</li></ul><blockquote>Good bread is the most fundamentally satisfying of all foods.</blockquote></div></div>
<div id="comments"><h3>2 comments</h3><ol class="commentlist"><li><p>Great recipe, thank you!</p></li><li><p>Mine came out rather flat.</p></li></ol></div>
<div id="sidebar"><h4>Archives</h4><ul><li><a href="/1">April</a></li><li><a href="/2">March</a></li></ul></div><div id="footer"><p>Copyright 2019 My Kitchen. All rights reserved.</p></div></div></body></html>""",
        "How I bake bread|Flour, water, salt and time are all you need for a good loaf.|Mix the flour with lukewarm water and let it rest for an hour before you add the salt.|Baking|Heat the oven to 240 degrees.|Bake for forty minutes.|Good bread is the most fundamentally satisfying of all foods.",
    ),
    # a newspaper
    (
        """<!doctype html><html><body><div class="cookie-banner" role="dialog"><p>We use cookies to improve your visit.</p><button>Accept</button></div><header class="masthead"><a href="/">The Daily</a><nav class="main-nav"><ul><li><a href="/w">World</a><li><a href="/s">Sport</a></ul></nav></header>
<main><article class="story"><h1>River rises after a week of rain</h1><figure><img src=a.jpg alt="x"><figcaption>The river on Tuesday morning.</figcaption></figure><p>The river rose by two metres on Monday, and the old bridge was closed to traffic.</p>
<div class="advert"><p>Advertisement</p><a href="/buy">Buy boots now</a></div><p>The mayor said that help was on its way, but that people should stay at home.</p><aside class="related-links"><h3>Related</h3><ul><li><a href="/r1">Floods of 2002</a></ul></aside><p>More rain is expected on Thursday.</p></article></main>
<section class="newsletter-signup"><form action="/s"><label>Your address</label><input name=m><button>Subscribe</button></form></section><footer><ul><li><a href="/t">Terms</a><li><a href="/p">Privacy</a></ul><p>&copy; The Daily</p></footer></body></html>""",
        "River rises after a week of rain|The river on Tuesday morning.|The river rose by two metres on Monday, and the old bridge was closed to traffic.|The mayor said that help was on its way, but that people should stay at home.|More rain is expected on Thursday.",
    ),
    # documentation
    (
        """<html><body><nav class="toc-sidebar"><ul><li><a href="#a">Install</a><li><a href="#b">Use</a></ul></nav><div role="main" class="body"><h1>Getting started</h1><p>This tool copies files between two machines.</p><h2>Install</h2><pre>make install</pre><p>It needs a compiler &amp; a shell.</p>
<table><tr><th>Option</th><th>Meaning</th></tr><tr><td>-v</td><td>say more</td></tr></table><dl><dt>quiet</dt><dd>Say nothing at all.</dd></dl></div><div class="footer">Page made by a script.</div></body></html>""",
        "Getting started|This tool copies files between two machines.|Install|make install|It needs a compiler & a shell.|Option|Meaning|-v|say more|quiet|Say nothing at all.",
    ),
    # an old page without classes
    (
        """<html><body><h1>My trip to the sea</h1><p>We left on a Friday and drove all night.<p>In the morning we saw the water, grey and calm, and nobody spoke.<p data-a=it's>It's a place to go back to.<hr></body></html>""",
        "My trip to the sea|We left on a Friday and drove all night.|In the morning we saw the water, grey and calm, and nobody spoke.|It's a place to go back to.",
    ),
    # a magazine of nested boxes
    (
        """<html><body><div class="topbar"><span>Login</span></div><div class="container"><div class="row"><div class="col-8 article-body"><h1 class="headline">Why owls turn their heads</h1><div class="byline">By J. Smith</div><div class="text"><p>An owl can turn its head by some 270 degrees.</p><p>Its neck has <a href="/v">fourteen vertebrae</a>, twice as many as ours.</p></div><div class="share-buttons"><a href="#">Share</a><a href="#">Tweet</a></div></div>
<div class="col-4 sidebar"><div class="widget"><h4>Most read</h4><ul><li><a href="/1">Ten birds</a></li></ul></div><div class="ad-slot">Cheap flights today</div></div></div></div><div class="site-footer"><p>Imprint and contact</p></div></body></html>""",
        "Why owls turn their heads|An owl can turn its head by some 270 degrees.|Its neck has fourteen vertebrae, twice as many as ours.",
    ),
    # an encyclopedia
    (
        """<html><body><div id="mw-head"><ul class="menu"><li><a href="/l">Log in</a></li></ul></div><div id="content" class="mw-body"><h1>Granite</h1><div id="bodyContent"><p><b>Granite</b> is a coarse-grained rock of quartz and feldspar.</p><h2>Use</h2><p>It has been used for buildings since antiquity.</p><ul><li>Obelisks in Egypt are of granite.</li></ul></div></div><div id="mw-navigation"><ul><li><a href="/m">Main page</a></li><li><a href="/h">Help</a></li></ul></div><div id="footer"><ul><li>This page was last edited in May.</li></ul></div></body></html>""",
        "Granite|Granite is a coarse-grained rock of quartz and feldspar.|Use|It has been used for buildings since antiquity.|Obelisks in Egypt are of granite.",
    ),
    # a page with mathematics and a canvas
    (
        """<html><body><header><h2>Notes on numbers</h2></header><article><h1>Squares</h1><p>The sum of the first odd numbers is <math><mi>n</mi><mo>&#178;</mo></math>.</p><canvas>A picture of squares.</canvas><p title='a > b'>One sees it <b>at once</b> from a picture.</p></article><div class="comments"><article class="comment"><p>Nice proof.</p></article></div></body></html>""",
        "Squares|The sum of the first odd numbers is n².|A picture of squares.|One sees it at once from a picture.",
    ),
]
