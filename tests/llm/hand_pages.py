"""Pages written and labelled by hand: a block that begins with the mark belongs to the main text. None is used in training."""

MARK = "§"

PAGES = [
    # article element with a code listing
    """<html><body><nav><a href="/">Home</a> <a href="/docs">Docs</a></nav><article><h1>§Reading a file</h1>
    <p>§Open the file first, then read it line by line so that memory stays small.</p><pre>§with open(path) as f:
        for line in f: print(line)</pre><p>§The file is closed at the end of the block.</p></article><footer>Example Docs 2024</footer></body></html>""",
    # main with a data table
    """<body><header><a href="/">Weather</a></header><main><h1>§Rain in the valley</h1><p>§The gauges by the river have been read each morning since spring.</p>
    <table><tr><th>§Month</th><th>§Rain</th></tr><tr><td>§April</td><td>§41 mm</td></tr><tr><td>§May</td><td>§63 mm</td></tr></table>
    <p>§May was the wettest month, though two gauges were out of order for a week.</p></main><footer>Contact us</footer></body>""",
    # plain div layout
    """<body><div><div><a href="/a">Start</a> | <a href="/b">News</a> | <a href="/c">About</a></div><div><h1>§The old mill reopens</h1>
    <p>§After nine years of repairs the old mill by the bridge turns again, and visitors are let in on Sundays.</p>
    <p>§The wheel was rebuilt from oak; the stones are those of the last century and still grind well.</p>
    <p>§A small bakery next door will use the flour from June on.</p></div><div>Copyright Valley Press</div></div></body>""",
    # table layout
    """<body><table><tr><td><a href="/1">Index</a><br><a href="/2">Links</a><br><a href="/3">Guestbook</a></td>
    <td><h2>§How I built my telescope</h2><p>§The mirror took the longest, about three months of grinding in the evenings, with many tests in between.</p>
    <p>§For the tube I used a length of drain pipe, painted black on the inside to keep out stray light.</p></td></tr>
    <tr><td>Last updated in May</td></tr></table></body>""",
    # foreign names
    """<body><div id="kopf"><a href="/">Startseite</a></div><div id="inhalt"><h1>§Der Garten im Herbst</h1>
    <p>§Wer jetzt die Beete abdeckt, hat im Frühjahr weniger Arbeit und lockeren Boden unter dem Laub.</p>
    <p>§Rosen schneidet man erst nach dem letzten Frost, sonst treiben sie zu früh aus und leiden.</p></div>
    <div id="impressum">Impressum: Verlag Muster, Berlin</div></body>""",
    # unnamed replies after an article
    """<body><article><h1>§A walk along the coast</h1><p>§The path begins behind the harbour and climbs through gorse to the first headland, where seals rest.</p>
    <p>§Allow five hours and take water, for there is no spring on the way.</p></article>
    <div><h3>Replies</h3><div><p>Anna</p><p>We walked it last week and saw no seals at all, but the view was worth every step.</p></div>
    <div><p>Ben</p><p>Thanks for the hint with the water, we would have forgotten it.</p></div></div></body>""",
    # sections without names, menu as a list
    """<body><section><ul><li><a href="/x">Products</a></li><li><a href="/y">Prices</a></li><li><a href="/z">Help</a></li></ul></section>
    <section><h1>§Why bread rises</h1><p>§Yeast eats sugar and gives off gas, and the gas is held by strands of gluten that stretch like a balloon.</p>
    <ul><li>§Warm water wakes the yeast.</li><li>§Salt slows it down.</li></ul><p>§Too much time, and the strands tear, so that the loaf falls flat in the oven.</p></section></body>""",
    # advert inside the article
    """<body><article><h1>§Night trains return</h1><p>§Three new lines will start in autumn, and the first tickets were sold out within an hour of the opening.</p>
    <div class="ad">Buy two suitcases, get one free!</div><p>§The carriages are new; each compartment has its own shower and a window that opens.</p></article></body>""",
    # old page with a form and a footer
    """<body><form action="/s"><label>Search</label><input name="q"><button>Go</button></form><div class="content"><h1>§Bees on the roof</h1>
    <p>§Five hives stand on the roof of the town hall, and the honey is given to the schools each summer.</p>
    <blockquote>§Bees find more flowers in a town than on a field of maize.</blockquote></div><div class="footer">All rights reserved</div></body>""",
    # sidebar in a table cell
    """<table><tr><td><p>§Chess openings fall into open and closed games, and the difference lies in whether the pawns in the centre are exchanged.</p>
    <p>§Beginners do well to learn the open ones first, since pieces come out quickly and plans are plain.</p></td>
    <td><a href="/1">Openings</a><br><a href="/2">Endgames</a></td></tr></table>""",
    # made-up names
    """<body><div class="zr4"><a href="/">Logo</a></div><div class="qwx"><h1>§Measuring the tide</h1>
    <p>§A float in a pipe follows the sea without the waves, and a pen on the float draws the curve on a drum.</p>
    <p>§The drum turns once a week, and each sheet is kept in the archive of the harbour office.</p></div><div class="kk1">Harbour office, Quay 3</div></body>""",
    # definition list
    """<body><nav><ul><li><a href="/g">Glossary</a></li><li><a href="/m">Maps</a></li></ul></nav><main><h1>§Words of sailing</h1>
    <dl><dt>§Luff</dt><dd>§The front edge of a sail, which shakes when the boat points too high.</dd><dt>§Leech</dt><dd>§The edge at the back, from head to clew.</dd></dl></main></body>""",
    # list of replies named as comments
    """<body><div id="content"><h1>§Soup for cold days</h1><p>§Fry the onions slowly until they are brown, pour in the broth and let it all simmer for an hour.</p>
    <p>§Serve with bread and a spoon of cream.</p></div><ol class="commentlist"><li class="comment"><p>Great recipe, my children loved it and asked for more.</p></li>
    <li class="comment"><p>I took leeks instead of onions.</p></li></ol></body>""",
    # notice above, related links below
    """<body><div class="cookie-banner">We use cookies to improve your stay. <button>OK</button></div><article><h1>§The comet of the year</h1>
    <p>§It rises before dawn in the east and is best seen from a hill without street lamps nearby.</p><p>§By the end of the month it will have faded.</p></article>
    <div class="related"><ul><li><a href="/p">Planets in June</a></li><li><a href="/q">Eclipse guide</a></li></ul></div></body>""",
    # divs as paragraphs
    """<body><div><a href="/h">Home</a></div><div><div>§The ferry leaves at six, and whoever comes late waits until noon for the next one to sail.</div>
    <div>§On board there is tea, and on clear days the far islands can be seen from the upper deck.</div>
    <div>§Dogs travel free, bicycles cost the same as a child.</div></div><div><a href="/i">Imprint</a> <a href="/k">Privacy</a></div></body>""",
    # figure and caption
    """<body><header><h2>City Museum</h2></header><article><h1>§A clock with one hand</h1><figure><img src="c.png"><figcaption>§The clock after cleaning, 1998</figcaption></figure>
    <p>§Only hours mattered when it was built, so its maker left out the second hand and nobody missed it.</p></article><aside><p>Open daily except Monday</p></aside></body>""",
    # Spanish names
    """<body><div id="menu"><a href="/">Inicio</a><a href="/v">Viajes</a></div><div id="contenido"><h1>§El faro del norte</h1>
    <p>§El faro se levantó en tres años con piedra de la isla, y su luz alcanza treinta millas en las noches claras.</p>
    <p>§Hoy nadie vive en él, pero una vez al mes se puede subir hasta la linterna.</p></div><div id="pie">Todos los derechos reservados</div></body>""",
    # header, breadcrumbs and share buttons
    """<body><div class="breadcrumbs"><a href="/">Home</a> <a href="/s">Science</a></div><div class="post-body"><h1>§Why ice floats</h1>
    <p>§Water is densest at four degrees, so ponds freeze from above and fish live on below the lid of ice.</p></div>
    <div class="share"><a href="/f">Share</a> <a href="/t">Send</a></div></body>""",
    # replies without a heading, in a list of sections
    """<body><div><h1>§Repairing a kettle</h1><p>§Unplug it, turn it over and take out the three screws below the base; keep them in a cup.</p>
    <p>§If the switch is loose, bend its tongue a little upward and test it before closing.</p><p>§Mine has worked for another six years since then.</p></div>
    <div><div><h4>Carl</h4><p>My kettle has four screws.</p></div><div><h4>Dora</h4><p>Worked like a charm, thank you so much.</p></div><div><h4>Emil</h4><p>Buy a new one instead.</p></div></div></body>""",
    # body text directly under the page
    """<h1>§Notes on moss</h1><p>§Moss has no roots and drinks through its leaves, which is why it likes walls that face north.</p>
    <p>§It survives years of drought and turns green within minutes of the first rain.</p><p>§A lens with tenfold power shows most of what tells the kinds apart.</p><hr><a href="/">Back</a>""",
]
