"""Word lists of the text functions, in no order that matters."""

#: Frequent English and Swedish words, and single signs, that full-text queries pass by.
STOP_WORDS = frozenset(
    """
0 1 2 3 4 5 6 7 8 9 a i ha be de he se if of om an en in on än no so to up or ur är as is at it ut åt nu av by då få på så ska nya had vad med vid and
the one are tre use sig tog och bli del all dem him kom som can kan man den men sin who two upp har var her mer per for hur där här när får går för
gör has was his its det set mot not att ett but out new may any två båda hela alla sina bara vara fyra ofta hade made både name same time some were
more inte have each such with both fick dock well till vill will them inom from form than utan been then when åren även från also into over över blir
this that helt allt samt part most sitt sätt blev they only many AS IS många olika cirka samma denna andra flera några stora dessa vissa detta could
would bland since kunde three varje while there where these being which antal genom medan redan sedan innan delen often någon other eller after efter
their fanns finns annat varit något first about själv också första gjorde skulle became senare during mellan vilken kommer därför kallas states mycket
vilket enligt endast främst kallade because through several between Software although eftersom därefter different stopwords.h
""".split()
)

#: Top-level domains whose pages are kept.
TOP_LEVEL_DOMAINS = frozenset(
    """
travelersinsurance cancerresearch institute[50] lifeinsurance spreadbetting international entertainment construction scholarships engineering
foodnetwork blockbuster motorcycles enterprises productions contractors accountants investments blackfriday photography creditcard healthcare
realestate consulting basketball republican foundation protection industries properties associates apartments restaurant accountant management
technology university insurance furniture homesense marketing financial education frontdoor christmas analytics homegoods vacations solutions
equipment directory community catholic download airforce mortgage exchange showtime software boutique plumbing clothing cleaning training shopping
catering lighting feedback memorial hospital baseball football engineer computer observer graphics diamonds services supplies pictures ventures
holdings bargains builders partners business democrat uconnect discount barefoot broadway pharmacy attorney delivery security property organic leclerc
exposed limited youtube finance science storage college forsale audible compare theatre website trading wedding fishing cooking hosting network
digital capital channel kitchen fashion auction whoswho weather theater monster realtor watches singles recipes cruises courses rentals systems
domains origins coupons guitars careers winners flowers fitness express tickets markets flights reviews contact cricket support florist dentist
hangout holiday academy company grocery surgery gallery jewelry country charity bestbuy africa camera clinic coffee degree voyage circle google mobile
online secure insure cruise estate active racing dating voting living search church health global social dental travel school webcam stream museum
garden design vision coupon boston amazon studio physio casino tattoo hiphop makeup soccer career kosher locker broker center lawyer repair author
doctor villas tennis hotels claims condos photos yachts events select direct market credit expert report review agency hockey energy mobily family
supply luxury realty beauty media ninja vodka edeka pizza rehab music build world cloud place space dance trade guide movie bible smile apple style
prime phone gripe store lease horse house drive sling coach watch irish faith earth archi black click co.uk legal final email forum green salon video
rodeo bingo radio audio promo photo lotto volvo cheap group solar poker actor cards codes games homes tunes shoes tires gives rocks sucks works deals
tools loans autos tours glass press gifts boots parts adult sport trust today rugby study money party yoga data club read gold band land fund food
tube free cafe safe life page bike like sale game name meme wine zone care here fire case date site vote blue save live love sncf golf prof surf wang
song blog tech rich cash fish mobi wiki taxi duck talk silk bank link pink book work deal fail call cool team film room farm loan open skin qpon cern
porn town info limo aero zero auto help camp shop coop beer hair jobs pics docs fans tips cars plus news toys chat fiat lgbt meet diet gift reit rent
mint spot fast best rest host post menu cyou guru show baby army city navy sexy buzz mba cpa cab pub inc dad med red wed cfd bid pid ltd ice gle one
moe off wtf ing ong dog org sbi ski fyi ink tel mil onl lol cam kim com mom fan gdn men pin vin win fun run eco ceo ngo bio uno boo foo ooo pro map
rip vip zip gop top app esq bar car ads aws eat lat bet net pet vet fit int bot dot hot art ntt icu edu you dev hiv gov mov law new how now wow tax
sex box xxx day gay pay diy sky fly joy buy biz xyz ca la ac cc sc ad cd me se tf gg sh ai gi dj uk bm fm co io to as bs ms us ws au gu nu tv az bz
""".split()
)
