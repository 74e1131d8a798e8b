"""Twenty page layouts written by hand, each with two written texts; none is shared with
the maker that the default field is trained on. {t} is the title, {a} to {d} paragraphs;
what stands behind the bar is the main text, lines parted by |."""

TEXTS = [
    {
        "t": "The lighthouse at the end of the spit",
        "a": "For eighty years the lamp was lit by hand, and the keeper's family lived in the two rooms below it.",
        "b": "Nobody who grew up in the village remembers a night without its slow white beam over the roofs.",
        "c": "When the light was made automatic, the last keeper stayed on for a winter and painted the stairs.",
        "d": "Today a small museum shows his logbooks, the brass oil can and a great many photographs of storms.",
    },
    {
        "t": "Why your tomatoes split",
        "a": "Tomatoes split when they take up more water in a night than their skin can stretch to hold.",
        "b": "A long dry spell makes the skin tough; the first heavy rain then does the damage within hours.",
        "c": "Water a little every other day, in the morning, and cover the soil with straw or cut grass.",
        "d": "Split fruit is perfectly good to eat, but it should be picked at once, before the wasps find it.",
    },
]

NAV = '<ul><li><a href="/">Home</a></li><li><a href="/new">New</a></li><li><a href="/about">About us</a></li></ul>'
END = "<footer><p>&copy; 2021 Some House. All rights reserved.</p></footer>"

LAYOUTS = [
    # main text in a section of main
    (f"<body><nav>{NAV}</nav><main><section><h1>{{t}}</h1><p>{{a}}</p><p>{{b}}</p></section></main>{END}</body>", "{t}|{a}|{b}"),
    # a section with an id is all there is
    (f"<body><header><a href='/'>Some House</a></header><section id=main><h1>{{t}}</h1><p>{{a}}</p><p>{{b}}</p><p>{{c}}</p></section>{END}</body>", "{t}|{a}|{b}|{c}"),
    # an article cut into sections
    (f"<body><article><h1>{{t}}</h1><section><h2>Then</h2><p>{{a}}</p><p>{{b}}</p></section><section><h2>Now</h2><p>{{c}}</p><p>{{d}}</p></section></article>{END}</body>", "{t}|Then|{a}|{b}|Now|{c}|{d}"),
    # content in sections of a box
    (f"<body><div class=header>Some House</div><div class=content><section><h2>{{t}}</h2><p>{{a}}</p></section><section><p>{{b}}</p></section></div><div class=footer>Imprint</div></body>", "{t}|{a}|{b}"),
    # a body with a class that speaks of a side bar
    (f"<body class='has-sidebar'><div class=page><article><h1>{{t}}</h1><p>{{a}}</p><p>{{b}}</p></article><aside><h3>Lately</h3><ul><li><a href=/1>Old boats</a></li></ul></aside></div>{END}</body>", "{t}|{a}|{b}"),
    # several of them, and a banner
    (f"<body class='home sidebar-right logged-out'><div class=page><div class=banner><p>Winter sale: everything must go.</p></div><article><h1>{{t}}</h1><p>{{a}}</p><p>{{b}}</p><p>{{c}}</p></article></div>{END}</body>", "{t}|{a}|{b}|{c}"),
    # hidden blocks of three kinds
    (f"<body><article><h1>{{t}}</h1><p>{{a}}</p><div hidden>This text is for search engines only and nobody sees it.</div><p>{{b}}</p><p style='display:none'>An old version of the second paragraph stood here.</p><div aria-hidden='true'>Opens a larger picture of the scene.</div><p>{{c}}</p></article>{END}</body>", "{t}|{a}|{b}|{c}"),
    # a table as the frame, links in a cell
    (f"<body bgcolor=white><table width=100%><tr><td valign=top><a href=/>Home</a><br><a href=/n>News</a><br><a href=/l>Links</a></td><td><h1>{{t}}</h1><p>{{a}}</p><p>{{b}}</p><p>{{c}}</p></td></tr></table></body>", "{t}|{a}|{b}|{c}"),
    # definitions inside the article
    (f"<body><nav class=menu>{NAV}</nav><main><h1>{{t}}</h1><p>{{a}}</p><dl><dt>Keeper</dt><dd>{{b}}</dd><dt>Winter</dt><dd>{{c}}</dd></dl><p>{{d}}</p></main>{END}</body>", "{t}|{a}|Keeper|{b}|Winter|{c}|{d}"),
    # figures with captions
    (f"<body><header class=site-header><p>Some House</p></header><div id=content><h1>{{t}}</h1><figure><img src=x.jpg><figcaption>As it looked in the summer of 1961.</figcaption></figure><p>{{a}}</p><p>{{b}}</p></div>{END}</body>", "{t}|As it looked in the summer of 1961.|{a}|{b}"),
    # paragraphs by double line breaks
    (f"<body><div class=topnav><a href=/>Home</a> | <a href=/a>Archive</a></div><div class=post><h2>{{t}}</h2><div class=post-text>{{a}}<br><br>{{b}}<br /><br />{{c}}</div></div><div id=footer>Contact the editor</div></body>", "{t}|{a}|{b}|{c}"),
    # an article with a header and a footer of its own
    (f"<body><article><header><h1>{{t}}</h1><p class=byline>By M. Orr, 3 May</p></header><p>{{a}}</p><p>{{b}}</p><p>{{c}}</p><footer>Filed under: coast.</footer></article></body>", "{t}|{a}|{b}|{c}"),
    # details that open
    (f"<body><nav>{NAV}</nav><article><h1>{{t}}</h1><p>{{a}}</p><details><summary>More on this</summary><p>{{b}}</p></details><p>{{c}}</p></article><section class=comments><h3>Comments</h3><p>I was there last year and loved it.</p></section></body>", "{t}|{a}|More on this|{b}|{c}"),
    # deep boxes without names
    (f"<body><div><div><div>{NAV}</div></div><div><div><div><h1>{{t}}</h1><div><p>{{a}}</p><p>{{b}}</p></div><div><p>{{c}}</p></div></div></div></div><div><div>{END}</div></div></div></body>", "{t}|{a}|{b}|{c}"),
    # a shop's advice page with a sign-up
    (f"<body><div class='promo-bar'>Free delivery over 50 pounds</div><header><nav>{NAV}</nav></header><main role=main><div class=container><div class=row><h1>{{t}}</h1><p>{{a}}</p><p>{{b}}</p><div class='newsletter'><form><label>Mail</label><input><p>Never miss a letter from us.</p><button>Go</button></form></div><p>{{c}}</p></div></div></main>{END}</body>", "{t}|{a}|{b}|{c}"),
    # lists and quotes
    (f"<body><div class=wrapper><div class=main-content><h1>{{t}}</h1><p>{{a}}</p><ul><li>{{b}}</li><li>{{c}}</li></ul><blockquote><p>{{d}}</p></blockquote></div><div class=sidebar><h4>Also read</h4><ul><li><a href=/2>Ropes and knots</a></li></ul></div></div>{END}</body>", "{t}|{a}|{b}|{c}|{d}"),
    # a page of a few long sentences in a bare body
    ("<body><h1>{t}</h1><p>{a}<p>{b}<p>{c}<p>{d}</body>", "{t}|{a}|{b}|{c}|{d}"),
    # cookie wall before, related after
    (f"<body class='article-page cookie-open'><div id='cookie-consent'><p>We value your privacy and use cookies.</p><button>Accept all</button></div><div class='article__body'><h1>{{t}}</h1><p>{{a}}</p><p>{{b}}</p></div><div class='related'><h3>You may also like</h3><p><a href=/3>A walk along the river</a></p></div>{END}</body>", "{t}|{a}|{b}"),
    # a report with a table of data
    (f"<body><header><h2>Some House</h2></header><main><article><h1>{{t}}</h1><p>{{a}}</p><table><tr><th>Year</th><th>Nights</th></tr><tr><td>1961</td><td>365</td></tr></table><p>{{b}}</p></article></main>{END}</body>", "{t}|{a}|Year|Nights|1961|365|{b}"),
    # advertisements between the paragraphs
    (f"<body><div class='site'><div class='entry'><h1>{{t}}</h1><p>{{a}}</p><div class='ad-slot'><p>Advertisement</p><p>Buy two pairs of boots and get a third one free.</p></div><p>{{b}}</p><div class='share'><a href=#>Share</a> <a href=#>Post</a></div><p>{{c}}</p></div></div>{END}</body>", "{t}|{a}|{b}|{c}"),
]

PAGES = [(f"<!doctype html><html><head><title>{x['t']} - Some House</title></head>{html.format(**x)}</html>", main.format(**x)) for html, main in LAYOUTS for x in TEXTS]
