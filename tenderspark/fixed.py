"""Fixed values.

Word lists, lookup tables and labels that results depend on.  They are stated
here as plain text, one value per line, and are not to be reordered.
"""


def _lines(block: str) -> tuple[str, ...]:
    return tuple(line for line in block.strip("\n").split("\n") if line)


def _pairs(block: str) -> tuple[tuple[str, str], ...]:
    return tuple(tuple(line.split(" => ")) for line in _lines(block))


# --- fixed values: description clean-up -------------------------------------
ADMIN_LEAD_PHRASES = _lines("""
this is a combined synopsis
this announcement constitutes
this is a sources sought
this is a request for information
this notice does not constitute
issued solely for information
issued for market research
is conducting market research
is issuing this notice
notice of intent
offers are being requested
this solicitation is issued
the solicitation document and incorporated
the solicitation document is
incorporated provisions and clauses
this solicitation is set-aside
this solicitation is set aside
the associated north american industrial
the associated naics
the fsc/psc is
combined synopsis/solicitation notice
iaw far
in accordance with far
this synopsis is not a request
this notice is not a solicitation
as defined by far
disclaimer:
this is a sources sought notice only
all information submitted
all information contained in this rfi
all responses
shall not be construed as a commitment
is in no way binding
subject to modification
the government will not pay
the government is requesting
responsibility of the interested parties
interested parties to monitor
information submitted in response
is preliminary as well as subject
this request for information does not commit
this rfi is issued solely
is issued solely for information
does not constitute a request
promise to issue an rfp
""")

FILLER_PHRASES = _lines("""
see attached
please see the attached
refer to the attached
bid due date
final supplier quotation
key action dates
this is q&a
this is addendum
see the attached
summary of changes
supplier quotation due
bidder conference
bidders conference
pre-bid conference
pre bid conference
site visit
site walk
please note
please allow time
sign-in
submission date is
addendum has been posted
questions and answers
proposal submission
questions regarding this event
submitted in writing
procurement official
event package cover page
view event package
click on the view
no later than
qualification statements
statements of qualifications
screening committee
by submitting an offer
agrees to the terms
firms interested in responding
must notify the university
the offeror must hold
brand name item:
essential/significant physical
this notice does not constitute
this is a sources sought
this is a request for information
this is a combined synopsis
this announcement constitutes
offers are being requested
notice of intent to sole source
notice of intent (noi)
is conducting market research
issued solely for information
issued for market research
is issuing this notice
i certify
per vaar
per far
no contract will be awarded
salient characteristics listed
to my knowledge
approved by:
name, date:
distribution statement
this solicitation is issued
the solicitation document
incorporated provisions and clauses
this solicitation is set-aside
this solicitation is set aside
the associated north american industrial
the associated naics
combined synopsis/solicitation notice
iaw far
in accordance with far
this acquisition is set aside
1. solicitation number
2. notice type
3. classification code
psc:
naics:
size standard:
this synopsis is not a request
this notice is not a solicitation
as defined by far
disclaimer:
this is a sources sought notice only
shall not be construed as a commitment
is in no way binding
subject to modification
the government will not pay
the government is requesting
responsibility of the interested parties
information submitted in response
is preliminary as well as subject
this request for information does not commit
this rfi is issued solely
is issued solely for information
does not constitute a request
promise to issue an rfp
all offers are subject to all terms
sealed offers in original
amendment to clause
the government is not at this time seeking
responders are advised
respondents are advised
all costs associated with
justification for other than full and open
if this contract is covered by
when the government requires supplies
the contractor must provide employees
secure cloud computing architecture on aws
all rights reserved
aws prescriptive guidance
copyright ©
copyright (c)
fringe benefits required
wage determination
minimum order
maximum order
address the offer to
address offer to
issued by code
name and address of contractor
paid sick leave
executive order minimum wage
occupational listing
purchase number note
sealed bid solicitations
rated order under the defense priorities
applicable executive order minimum wage
must provide employees
""")

DOCUMENT_LEAD_PHRASES = _lines("""
this is a combined synopsis
this announcement constitutes
this is a sources sought
this is a request for information
this notice does not constitute
issued solely for information
issued for market research
is conducting market research
is issuing this notice
notice of intent
offers are being requested
see the attached
please see the attached
""")

PROJECT_LEAD_PHRASES = _lines("""
seeking
is releasing
requesting
request for
purpose of this
scope of work
scope of services
intent of this
the contractor
the bidder
proposals from
qualified bidders
will provide
shall provide
this solicitation
this rfp
this rfq
this rfi
""")

PROJECT_SIGNAL_PHRASES = _lines("""
shall provide
shall ensure
shall perform
shall include
shall deliver
shall supply
shall install
will provide
will deliver
will perform
will supply
is seeking
seeks to procure
seeks to
intends to
is releasing
is requesting proposals
is requesting quotes
requirement is to
this requirement is
the system will
the system shall
the system must
the solution will
the solution shall
the project
this project
the contractor shall
the vendor shall
to procure
to acquire
to purchase
the platform
the application
describes the framework
sets forth the objectives
supports the
supports naval
supports the mission
provides the framework
provides a framework
is to procure
is to provide
""")

SUBMISSION_PHRASES = _lines("""
statement of qualifications
statements of qualifications
qualification statements
submitted electronically
submitted in writing
submit
no later than
screening criteria
screening committee
reference checks
interviews
proposal due
questions regarding
procurement official
event package cover page
responding to this rf
respond to this rf
agrees to the terms
by submitting an offer
this notice does not constitute
this announcement constitutes
this is a sources sought
this is a request for information
no contract will be awarded
issued for market research
issued solely for information
respondents are responsible for
respondents should
interested parties should
i certify
per vaar
per far
salient characteristics listed
the government will not
the government does not
anticipated period of performance
period of performance shall be
to my knowledge
""")

# The first two end in a blank on purpose.
OBLIGATION_PHRASES = ("shall ", "must ") + _lines("""
will provide
will deliver
will perform
will supply
will install
will furnish
to be provided
to be delivered
to provide
to deliver
to furnish
to install
to supply
responsible for
""")

QUESTIONNAIRE_MARKERS = (' if yes', ' if no', 'if "yes"', 'if "no"') + _lines("""
draft pws
encompass the requirement
more accurate proposal
technical and functional comments
please provide your
""")

# --- fixed values: description line markers -----------------------------------
TRAILER_LINES = _lines("""
view event package
view vendor ads
contact information
pre bid conference
pre-bid conference
unspsc codes
service area
contractor license type
""")

TRAILER_PREFIXES = _lines("""
pre bid conference
pre-bid conference
""")

ADDENDUM_WORDS = _lines("""
addendum
amendment
errata
q&a
q & a
q and a
page count discrepancy
summary of changes
""")

# --- fixed values: bullets and deliverables ---------------------------------
SECTION_HEADERS = _lines("""
deliverables
key deliverables
scope of work
scope of services
statement of work
tasks
key tasks
services to be provided
services provided
required services
work to be performed
""")

ACTION_WORDS = _lines("""
shall
must
will
provide
deliver
perform
install
supply
support
develop
implement
configure
integrate
design
manage
maintain
operate
execute
address
create
build
produce
track
report
monitor
ensure
submit
include
process
review
""")

GLUE_WORDS = _lines("""
the
of
a
an
to
in
for
and
or
with
from
on
by
as
that
this
are
is
be
all
""")

LABEL_EXCLUDES = _lines("""
bidder
conference
attendance
presentation
sign-in
q&a
q and a
question
addendum
amendment
errata
notice to
instructions to bidders
vendor ads
""")

LABEL_SPEC_HINTS = _lines("""
rfp
rfq
rfi
sow
scope
spec
specification
exhibit
statement of work
requirement
""")

# --- fixed values: attachment ranking and narrative filter --------------------
RANK_BLOCKLIST = _lines("""
response_spreadsheet
response spreadsheet
vendor question
q&a
q_and_a
questions
bidder
conference
attendance
presentation
sign-in
addendum
amendment
errata
""")

RANK_SPEC_HINTS = _lines("""
rfp
rfq
rfi
sow
scope
spec
specification
exhibit
statement of work
requirement
srd
pws
soo
""")

PROSE_WORDS = _lines("""
the
of
is
a
an
to
in
for
and
or
be
with
from
on
by
as
that
this
are
will
have
has
their
they
its
it
at
which
these
those
we
our
shall
must
""")

# --- fixed values: places -----------------------------------------------------
CITIES = _lines("""
Anaheim
Antioch
Bakersfield
Berkeley
Burbank
Carlsbad
Carson
Chico
Chula Vista
Citrus Heights
Clovis
Compton
Concord
Corona
Costa Mesa
Cupertino
Daly City
Davis
Downey
El Cajon
El Monte
Elk Grove
Escondido
Eureka
Fairfield
Fontana
Fremont
Fresno
Fullerton
Garden Grove
Glendale
Hanford
Hayward
Hesperia
Hollywood
Huntington Beach
Inglewood
Irvine
Jurupa Valley
Lancaster
Long Beach
Los Angeles
Merced
Mission Viejo
Modesto
Monterey
Moreno Valley
Mountain View
Murrieta
Napa
Newport Beach
Norwalk
Oakland
Oceanside
Ontario
Orange
Oxnard
Palmdale
Palo Alto
Pasadena
Pleasanton
Pomona
Porterville
Rancho Cucamonga
Redding
Redwood City
Rialto
Richmond
Riverside
Roseville
Sacramento
Salinas
San Bernardino
San Diego
San Francisco
San Jose
San Mateo
San Rafael
Santa Ana
Santa Barbara
Santa Clara
Santa Clarita
Santa Cruz
Santa Maria
Santa Monica
Santa Rosa
Simi Valley
South Gate
Stockton
Sunnyvale
Temecula
Thousand Oaks
Torrance
Tracy
Tulare
Vacaville
Vallejo
Ventura
Victorville
Visalia
Vista
Walnut Creek
West Covina
Westminster
Whittier
Yuba City
""")

# --- fixed values: tag vocabulary and rules -------------------------------------
TAG_VOCABULARY = _lines("""
IT Systems
Software
System Development
Cloud
SaaS
Cybersecurity
Data
GIS
Health Services
Medical Imaging
Fire Services
Forestry
Construction
Infrastructure
Electrical
Hardware
Logistics
Transportation
Environment
Water
Cannabis
Corrections
Legal & Courts
Finance
Operations
Procurement
Government
Training
Research
Consulting
""")

# substring => tag (a blank before the arrow beyond the first is part of the substring)
KEYWORD_RULES = _pairs("""
transformer => Electrical
electrical => Electrical
wiring => Electrical
conduit => Electrical
construction management => Construction
construction => Construction
install  => Construction
capital infrastructure => Infrastructure
infrastructure => Infrastructure
highway => Infrastructure
bridge => Infrastructure
pipeline => Infrastructure
calheers => Health Services
medi-cal => Health Services
medicaid => Health Services
healthcare => Health Services
health care => Health Services
eligibility => Health Services
hospital => Health Services
clinical => Health Services
medical center => Health Services
multivue => Medical Imaging
imaging => Medical Imaging
software as a service => SaaS
saas => SaaS
cloud-based => Cloud
cloud based => Cloud
cloud => Cloud
software licensing => Software
software subscription => Software
software => Software
information technology => IT Systems
system development => System Development
system enhancements => System Development
implementation services => System Development
implementation and configuration => System Development
erpa => IT Systems
limsr => IT Systems
limss => IT Systems
laboratory information management => IT Systems
cybersecurity => Cybersecurity
cyber  => Cybersecurity
bigfix => Cybersecurity
national change of address => Data
ncoa => Data
data center => Infrastructure
database => Data
geographic information system => GIS
gis  => GIS
aerial film => GIS
computer-aided dispatch => GIS
computer aided dispatch => GIS
cal fire => Fire Services
fire protection => Fire Services
forestry => Forestry
server => Hardware
hardware => Hardware
freight => Logistics
environmental => Environment
environment => Environment
watertap => Water
drinking water => Water
water resources => Water
water board => Water
swrcb => Water
cannabis => Cannabis
corrections => Corrections
rehabilitation => Corrections
court interpreter => Legal & Courts
judicial => Legal & Courts
court => Legal & Courts
franchise tax => Finance
budget development => Finance
financial tracking => Finance
financial management => Finance
onestream => Finance
maintenance & operations => Operations
maintenance and operations => Operations
operations support => Operations
training services => Training
research and development => Research
market research => Research
consulting services => Consulting
consultant => Consulting
procurement official => Procurement
solicitation => Procurement
""")

# two-digit commodity segment => tag
FAMILY_TAGS = _pairs("""
39 => Electrical
43 => IT Systems
44 => Hardware
70 => Environment
71 => Environment
72 => Construction
73 => Infrastructure
76 => Operations
77 => Environment
78 => Logistics
80 => Consulting
81 => IT Systems
82 => Operations
83 => Data
84 => Finance
85 => Health Services
86 => Training
92 => Government
93 => Government
""")

# --- fixed values: department names ---------------------------------------------
# alias => canonical name
DEPARTMENT_ALIASES = _pairs("""
California Department of Technology => California Department of Technology
Dept. of Technology => California Department of Technology
Department of Technology => California Department of Technology
CA Department of Technology => California Department of Technology
CDT => California Department of Technology
California Department of Transportation => California Department of Transportation
Caltrans => California Department of Transportation
CALTRANS => California Department of Transportation
CA DOT => California Department of Transportation
California Department of General Services => California Department of General Services
DGS => California Department of General Services
CA DGS => California Department of General Services
Dept. of General Services => California Department of General Services
California Department of Motor Vehicles => California Department of Motor Vehicles
CA DMV => California Department of Motor Vehicles
DMV => California Department of Motor Vehicles
California Department of Justice => California Department of Justice
CA DOJ => California Department of Justice
CADOJ => California Department of Justice
California Department of Public Health => California Department of Public Health
CDPH => California Department of Public Health
CA DPH => California Department of Public Health
California Department of Forestry and Fire Protection (CAL FIRE) => California Department of Forestry and Fire Protection (CAL FIRE)
California Department of Forestry and Fire Protection => California Department of Forestry and Fire Protection (CAL FIRE)
CAL FIRE => California Department of Forestry and Fire Protection (CAL FIRE)
CalFire => California Department of Forestry and Fire Protection (CAL FIRE)
Cal Fire => California Department of Forestry and Fire Protection (CAL FIRE)
CA Dept of Forestry and Fire Protection => California Department of Forestry and Fire Protection (CAL FIRE)
California Department of Developmental Services => California Department of Developmental Services
Department of Developmental Services => California Department of Developmental Services
DDS => California Department of Developmental Services
CA DDS => California Department of Developmental Services
California Department of Health Care Services => California Department of Health Care Services
Department of Health Care Services => California Department of Health Care Services
DHCS => California Department of Health Care Services
CA DHCS => California Department of Health Care Services
California State Water Resources Control Board => California State Water Resources Control Board
State Water Resources Control Board => California State Water Resources Control Board
State Water Resources Control => California State Water Resources Control Board
SWRCB => California State Water Resources Control Board
California Department of Water Resources => California Department of Water Resources
Department of Water Resources => California Department of Water Resources
of Water Resources => California Department of Water Resources
DWR => California Department of Water Resources
California Department of Cannabis Control => California Department of Cannabis Control
Department of Cannabis Control => California Department of Cannabis Control
Department of Cannabis Control (DCC) => California Department of Cannabis Control
DCC => California Department of Cannabis Control
Judicial Branch of California => Judicial Branch of California
Judicial Branch => Judicial Branch of California
Judicial Council of California => Judicial Branch of California
California Department of Parks and Recreation => California Department of Parks and Recreation
Department of Parks and Recreation => California Department of Parks and Recreation
Dept of Parks & Recreation => California Department of Parks and Recreation
Dept. of Parks and Recreation => California Department of Parks and Recreation
California State Parks => California Department of Parks and Recreation
California Franchise Tax Board => California Franchise Tax Board
Franchise Tax Board => California Franchise Tax Board
FTB => California Franchise Tax Board
CA FTB => California Franchise Tax Board
California Department of Corrections and Rehabilitation => California Department of Corrections and Rehabilitation
Department of Corrections and Rehabilitation => California Department of Corrections and Rehabilitation
Dept of Corrections & Rehab => California Department of Corrections and Rehabilitation
Dept. of Corrections and Rehabilitation => California Department of Corrections and Rehabilitation
CDCR => California Department of Corrections and Rehabilitation
of Motor Vehicles => California Department of Motor Vehicles
California Governor's Office of Emergency Services (Cal OES) => California Governor's Office of Emergency Services (Cal OES)
Office of Emergency Services => California Governor's Office of Emergency Services (Cal OES)
California Office of Emergency Services => California Governor's Office of Emergency Services (Cal OES)
Cal OES => California Governor's Office of Emergency Services (Cal OES)
CalOES => California Governor's Office of Emergency Services (Cal OES)
UC Davis Medical Center => UC Davis Medical Center
UC Davis Health => UC Davis Medical Center
Office of Technology and Solutions Integration (OTSI) => Office of Technology and Solutions Integration (OTSI)
Office of Technology and Solutions Integration => Office of Technology and Solutions Integration (OTSI)
OTSI => Office of Technology and Solutions Integration (OTSI)
Ofc Technology and Solutions I => Office of Technology and Solutions Integration (OTSI)
Ofc Technology and Solutions Integration => Office of Technology and Solutions Integration (OTSI)
Office of Tech and Solutions Integration => Office of Technology and Solutions Integration (OTSI)
United States Department of Defense => United States Department of Defense
DoD => United States Department of Defense
DOD => United States Department of Defense
Dept. of Defense => United States Department of Defense
United States Department of Homeland Security => United States Department of Homeland Security
DHS => United States Department of Homeland Security
Dept. of Homeland Security => United States Department of Homeland Security
General Services Administration => General Services Administration
GSA => General Services Administration
Cybersecurity and Infrastructure Security Agency => Cybersecurity and Infrastructure Security Agency
CISA => Cybersecurity and Infrastructure Security Agency
""")

ABBREVIATIONS = _pairs("""
Ofc => Office of
Ofc. => Office of
Dept => Department
Dept. => Department
Mgmt => Management
Mgmt. => Management
Admin => Administration
Admin. => Administration
Svcs => Services
Svcs. => Services
Srvcs => Services
Srvcs. => Services
Comm => Commission
Comm. => Commission
Ofcs => Offices
Bldg => Building
Bldg. => Building
Tech => Technology
Tech. => Technology
Info => Information
Info. => Information
""")

# --- fixed values: source and status names --------------------------------------
SOURCE_NAMES = _pairs("""
sam.gov => sam.gov
sam => sam.gov
cal eprocure => Cal eProcure
caleprocure => Cal eProcure
calprocure => Cal eProcure
planetbids => PlanetBids
planet bids => PlanetBids
bidnet direct => BidNet Direct
bidnet => BidNet Direct
""")

STATUSES = ("active", "closed", "cancelled", "awarded", "amended")

BID_STATUSES = ("reviewing", "pursuing", "no_bid", "submitted")

# --- fixed values: relevance ------------------------------------------------------
COMMODITY_PREFIXES = ("43", "80101507", "8111", "8116", "8311", "831216", "831217")

CLASS_PREFIXES = ("204", "205", "206", "207", "208", "209", "725", "726", "915", "920")

CLASS_KEYWORDS = _lines("""
software
computer
data processing
information technology
telecommunication
telecom
network
cloud
cyber
hardware
it services
internet
broadband
fiber optic
programming
systems integration
saas
server
database
""")

MEETING_WORDS = _lines("""
bidder conference
bidders conference
pre-bid conference
pre bid conference
site visit
site walk
industry day
""")

MANDATORY_WORDS = _lines("""
mandatory site visit
mandatory bidder
mandatory bidders
mandatory pre-bid
mandatory pre bid
mandatory industry day
attendance is mandatory
attendance is required
""")

PLACEHOLDER_MARKERS = _lines("""
[event title]
[detail description]
loading...
[contact
[email]
[phone]
[pre bid conference]
[mandatory]
[01/01/2001]
[12:00 am]
""")

# --- fixed values: portal time zones and labels -----------------------------------
ZONES = _pairs("""
EDT => America/New_York
EST => America/New_York
ET => America/New_York
PDT => America/Los_Angeles
PST => America/Los_Angeles
PT => America/Los_Angeles
""")

DETAIL_LABELS = _pairs("""
issuing organization => issuing_organization
solicitation number => solicitation_number
title => title
description => description
source id => source
publication => publication_date
publication date => publication_date
closing date => closing_date
location => location
solicitation type => solicitation_type
""")

# --- fixed values: scoring stop words ---------------------------------------------
KEYWORD_STOPWORDS = _lines("""
the
and
or
of
for
to
in
on
a
an
is
it
as
by
general
services
solutions
systems
technology
""")

AGENCY_STOPWORDS = _lines("""
the
of
and
or
department
dept
office
agency
bureau
division
branch
us
united
states
federal
state
""")

PLACE_STOPWORDS = _lines("""
the
of
and
or
state
city
county
north
south
east
west
northern
southern
eastern
western
""")

# --- fixed values: feed taxonomy --------------------------------------------------
INDUSTRY_TAGS = _lines("""
IT Systems
Software
System Development
Cloud
SaaS
Cybersecurity
Data
GIS
Hardware
Electrical
Infrastructure
""")

TOPIC_TAGS = _lines("""
Health Services
Medical Imaging
Fire Services
Forestry
Construction
Servers
Logistics
Transportation
Environment
Water
Cannabis
Corrections
Legal & Courts
Finance
Operations
Procurement
Government
Training
Research
Consulting
""")
