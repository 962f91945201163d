"""A few labelled web pages. Every line is one text block: `+` belongs to the main text, `-` does not."""

from __future__ import annotations

PAGES = (
    """
- <body><nav><ul><li><a href="/">Home</a></li>
- <li><a href="/world">World news</a></li>
- <li><a href="/sport">Sport</a></li></ul></nav>
- <div class="ad">Half price on every bicycle this week only.</div>
+ <article><h1>Herons return to the old canal</h1>
+ <p>After twenty years without a single nest, grey herons have come back to the old canal east of the mill.</p>
+ <p>Quietly.</p>
+ <p>Two pairs were seen in March, and a third one followed when the water had cleared.</p>
- <div class="ad">Boats for rent, call us today.</div>
+ <h2>What changed</h2>
+ <p>The town closed the <a href="/drain">upper drain</a> and planted reeds along the bank.</p>
+ <ul><li>Reeds along two miles</li>
+ <li>No motor boats</li></ul>
+ <p>So it goes on.</p></article>
- <footer>&copy; Mill Gazette &middot; All rights reserved.</footer></body>
""",
    """
- <body><header><h1>The Daily Ledger</h1>
- <p>Since 1921</p></header>
- <div class="cookie-notice">We use cookies to give you the best experience on our site.</div>
- <div class="breadcrumb"><a href="/">Home</a> / <a href="/food">Food</a></div>
+ <main><h1>Bread without kneading</h1>
- <p class="x"><div class="byline">By A. Miller, 3 May</div>
+ <p>Flour, water, salt and a night of patience are all that this loaf asks for.</p>
+ <p>Mix everything in the evening.</p>
+ <p>Wait.</p>
+ <table><tr><td>Flour</td>
+ <td>500 g</td></tr></table>
+ <p>Bake it in a closed pot for forty minutes and let it cool before you cut it.</p>
- <div class="share">Share this page with your friends</div>
- <form action="/news"><p>Your address for our weekly letter</p>
- <p>We never pass it on to anyone.</p></form></main>
- <aside><h3>More recipes</h3>
- <ul><li><a href="/r/1">Soup of leeks</a></li>
- <li><a href="/r/2">Plum cake for many guests</a></li></ul></aside>
- <section id="comments"><h2>Comments</h2>
- <p>I tried it twice and it never rose, but my neighbour swears by this recipe and bakes it each week.</p>
- <p>Great!</p></section>
- <footer><p>Contact us at the ledger house, 4 River Lane.</p></footer></body>
""",
    """
- <body><div id="header"><h1>Stonebridge Weekly</h1></div>
- <div id="menu"><a href="/">Start</a> <a href="/a">Archive</a> <a href="/c">Contact</a></div>
+ <div id="content"><h2>A bridge is weighed</h2>
+ <p><a href="/map">See the map of all bridges</a></p>
+ <p>Engineers have weighed the stone bridge for the first time since it was built.</p>
+ <p>They used forty sensors, one for each block of the arch, and a lorry full of gravel.</p>
+ <p>It held.</p>
+ <blockquote>We were surprised ourselves.</blockquote>
+ <p>The results are to be <a href="/report">published in a report</a> next spring.</p>
- <div class="related"><p>Read also: how the river was moved</p></div></div>
- <div id="sidebar"><p>The weather in Stonebridge today is mild with some rain in the late afternoon.</p>
- <p><a href="/w">Seven days</a></p></div>
- <div id="footer">Stonebridge Weekly, all rights reserved</div></body>
""",
    """
- <body><p><a href="/1">One</a> | <a href="/2">Two</a> | <a href="/3">Three</a></p>
+ <p>When the lighthouse was switched off the keeper stayed, because nobody had told him where else to go that winter.</p>
+ <p>He mended nets, read every book of the small library twice, and wrote letters that the boat took with it on Fridays.</p>
+ <p>In spring a new lamp came, smaller than the old one, and a machine that needed no keeper to turn it on at dusk.</p>
- <p><a href="/next">Next page</a></p>
- <p><a href="/imprint">Imprint</a> <a href="/privacy">Privacy</a></p></body>
""",
    """
- <body><div class="topbar">Free delivery on all orders</div>
- <header><nav><a href="/shop">Shop</a></nav>
- <p>Everything for your garden since 1950, now also on Sundays.</p></header>
+ <div class="wrap"><article class="post"><header><h1>Pruning in winter</h1>
- <p>Posted by the editors on Monday</p></header>
+ <p>Cut on a dry day above freezing.</p>
+ <h3>Tools</h3>
+ <ol><li>Sharp shears</li>
+ <li>A folding saw with fine teeth for the thick branches</li></ol>
- <aside><p>Our tip: shears of forged steel at a special price until the end of this month.</p></aside>
+ <p>Step back often and look at the whole tree.</p>
- <footer><p>Filed under: trees, winter</p></footer></article></div>
- <div class="comments"><article class="comment"><p>My apple tree has not borne fruit since I cut it as you say here.</p></article>
- <article class="comment"><p>Thanks!</p></article></div>
- <div role="contentinfo">Garden house, company number 12</div></body>
""",
    """
- <body><div class="gdpr consent">By going on you agree to our terms and to the use of data by our partners.</div>
- <div class="navbar"><ul><li><a href="/">Start page</a></li>
- <li>Offers</li></ul></div>
+ <div class="story"><h1>The last ferry</h1>
+ <p>Forty people crossed.</p>
+ <p>The captain had steered the ferry for thirty years and rang the bell one more time in the middle of the river.</p>
+ <p>Then silence.</p>
- <div class="promo">Order our calendar now</div>
+ <p>A bridge takes its place from next week on, and the ferry goes to a museum.</p></div>
- <div class="widget"><h4>Most read</h4>
- <p>Ten places to see before the summer ends and the crowds come back to town.</p></div>
- <div class="newsletter">Get our letter every Friday</div>
- <div class="social"><a href="/f">Follow us</a></div></body>
""",
    """
- <body><div role="navigation"><a href="/a">All</a> <a href="/b">New</a></div>
+ <div role="main"><h1>Minutes of the meeting</h1>
+ <p>Present: nine members.</p>
+ <p>The treasurer reported a small surplus, which is to be spent on chairs for the hall and paint for its door.</p>
+ <dl><dt>Votes</dt>
+ <dd>Seven for, two against</dd></dl>
- <div class="alert">This page will be moved soon.</div>
+ <p>The next meeting is in June.</p></div>
- <div class="sidebar"><article><h3>Choir</h3>
- <p>The choir meets on every second Tuesday in the hall, and new voices are welcome.</p></article></div>
- <div class="copyright">Hall society</div></body>
""",
    """
- <body><table><tr><td><a href="/x">Index</a></td>
- <td><a href="/y">Maps</a></td></tr></table>
+ <h1>Crossing the high pass on foot in the early days of autumn</h1>
+ <p>The path begins behind the chapel and climbs through larches for two hours before the first view opens to the south.</p>
+ <p>Above the trees there is no water, so fill your bottles at the spring where the cattle drink, and start before the sun is high.</p>
+ <p>From the top one sees three lakes, and on clear mornings the far sea as a thin bright line under the sky.</p>
- <p>Hits: 1200</p>
- <p><a href="/back">Back to the index of all walks</a></p></body>
""",
    """
- <body><aside>Members read without adverts and support our work.</aside>
+ <article><header><h2>From the archive</h2></header>
+ <p>Short note.</p>
+ <p><a href="/source">The whole letter can be read here in its first form</a></p>
+ <p><a href="/scan">Scan</a></p>
+ <ul><li><a href="/copy">Copy of 1902</a></li>
+ <li><a href="/other">Other hand</a></li></ul>
+ <p>Signed.</p></article>
- <article class="teaser"><p>Another letter from the same box was found in the attic last year.</p></article>
- <footer><p>Printed by the society of letters in a small number of copies, which are sold at the door.</p></footer></body>
""",
    """
- <body><nav><a href="/">Home</a> <a href="/essays">Essays</a></nav>
- <div class="ad">A quiet chair for long evenings, now in oak and in ash, delivered to your door within a week of your order.</div>
+ <article><h1>On the use of slow clocks</h1>
+ <p>There was a clock in my grandfather's shop that lost eleven minutes a day, and nobody ever set it right, because the whole street had learned to add them, and a clock that everyone corrects is as good as one that needs no correction at all.</p>
+ <p>I have thought of it often since, whenever a new machine was brought into the office and the old one carried away, although we had all learned by heart what was wrong with the old one and knew nothing yet about the faults of the new.</p>
+ <p>Add eleven.</p>
+ <p>What we call an improvement is in most cases an exchange of known errors for unknown ones, and the years in which the unknown ones are found out are the years in which people say that nothing works any more and that everything was better before.</p>
+ <p>I do not say that.</p>
+ <p>I say that someone ought to sit beside the new clock for a year with a pencil, and write down every day by how much it is wrong, before the old one is sold to a man who collects such things and will never look at its hands again.</p>
+ <p>That is all</p></article>
- <footer>Essays are sent to members on the first day of each month together with a list of books that the editors have read and liked since the last.</footer></body>
""",
    """
- <body><header><p>The parish paper, founded by the fathers of those who print it now and read by the sons of those who will.</p></header>
+ <main><p>Bells rang on Sunday for the first time since the tower was struck by lightning in the autumn of the year before last, and many came who had not come for years.</p>
+ <p>Rain fell.</p>
+ <p>The smallest of the bells had to be cast anew, and its voice is a little higher than before, which the choir has found out already and the rest of us will find out soon enough.</p>
+ <p>A collection was taken at the door, and what it brought is to be used for the roof, where the water still comes in whenever the wind stands in the west for more than an hour.</p></main>
- <div class="related"><p>Ten years ago in this paper, the old bell was heard in the next village, and the people there believed that a fire had broken out somewhere.</p></div>
- <footer><p>Written by many hands and printed on Fridays at the back of the school, where copies are kept for all who ask for one.</p></footer></body>
""",
)
