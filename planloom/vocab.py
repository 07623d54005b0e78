"""Closed vocabularies. They are constants of fixed size, so they may be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The planning checklist (key, category, question, team, default, scope), in order.
CHECKLIST = [
    ('merchant_count', 'COMMERCIAL_SCOPE', 'How many merchants or merchant entities are in scope?', 'commercial', '1', 'merchant'),
    ('offer_count', 'OFFER_COUNT', 'How many promotional offers will launch?', 'commercial', '10', 'offer'),
    ('pricing_terms', 'PRICING_TERMS', 'What are the pricing or revenue-share terms?', 'commercial', 'standard revenue-share model, terms to be confirmed', 'merchant'),
    ('contract_requirements', 'CONTRACT', 'What must be signed, and is signature a precondition for other work?', 'commercial', 'signed contract required before integration begins', 'merchant'),
    ('sla_targets', 'SLA_TARGETS', 'What uptime and support-response service levels are committed?', 'commercial', '99.5% uptime, 4 business-hour response for priority incidents', 'merchant'),
    ('earn_rate', 'EARN_RATE', 'How many points do customers earn per unit of currency spent?', 'technical', '10 points per 1 USD', 'offer'),
    ('points_expiry', 'POINTS_EXPIRY', 'When do accrued points expire?', 'technical', '12 months after accrual', 'offer'),
    ('auth_mechanism', 'AUTH_MECHANISM', "How do the platform and the merchant's system authenticate to each other?", 'technical', 'OAuth 2.0 client-credentials', 'project'),
    ('integration_target', 'INTEGRATION', 'Which merchant system is being integrated with, and by what interface?', 'technical', 'merchant POS via REST API', 'project'),
    ('performance_targets', 'PERFORMANCE', 'What throughput and latency must the integration sustain?', 'technical', '50 transactions/second peak, p95 under 300 ms', 'project'),
    ('location_count', 'LOCATION_COUNT', 'How many branches, stores, or locations participate?', 'operations', '3', 'merchant'),
    ('training_duration', 'TRAINING_DURATION', 'How long is staff training, and are there scheduling constraints?', 'operations', '2 days', 'merchant'),
    ('go_live_support', 'GO_LIVE_SUPPORT', 'How long is post-go-live support or hypercare?', 'operations', '30 days hypercare after go-live', 'project'),
    ('team_size', 'TEAM_SIZE', 'How many people are assigned, and in which roles?', '', '8 (2 commercial, 3 technical, 3 operations)', 'project'),
    ('project_start_date', 'SCHEDULE', 'When does the project start (kickoff or contract signature)?', '', 'immediately on contract signature', 'project'),
    ('go_live_date', 'SCHEDULE', 'What is the target go-live date?', '', 'not stated', 'project'),
    ('intermediate_milestones', 'INTERMEDIATE_MILESTONES', 'What dated milestones exist between start and go-live?', '', 'derived from task dependencies; not stated in the SOW', 'project'),
    ('offer_eligibility', 'OFFER_ELIGIBILITY', 'Which purchases or transactions qualify for an offer?', 'commercial', 'all in-store purchases qualify', 'offer'),
    ('offer_duration', 'OFFER_DURATION', 'How long does each offer run?', 'commercial', '30 days per offer', 'offer'),
    ('redemption_rules', 'REDEMPTION_RULES', 'How do customers redeem points, and against what?', 'commercial', 'points redeemable against purchase value at the till', 'offer'),
    ('redemption_limits', 'REDEMPTION_LIMITS', 'What caps apply per customer, per transaction or per period?', 'commercial', 'no cap stated', 'offer'),
    ('customer_eligibility', 'CUSTOMER_ELIGIBILITY', 'Who can join the loyalty programme, and how do they enrol?', 'commercial', 'any customer may enrol at the till', 'offer'),
    ('merchant_specific_offer_rules', 'MERCHANT_SPECIFIC_RULES', 'Do any offers behave differently for particular merchants or branches?', 'commercial', 'all offers behave identically across merchants', 'offer'),
    ('offer_approval_process', 'OFFER_APPROVAL', 'Who signs off an offer before it goes live?', 'commercial', 'merchant account manager approves each offer', 'offer'),
    ('offer_launch_schedule', 'OFFER_LAUNCH', 'When does each offer go live, and are they staggered?', 'commercial', 'all offers launch together at go-live', 'offer'),
    ('merchant_business_rules', 'MERCHANT_BUSINESS_RULES', 'What merchant-side business rules constrain the integration?', 'commercial', 'none beyond the standard programme rules', 'merchant'),
    ('merchant_contacts', 'MERCHANT_CONTACTS', 'Who at the merchant owns the project, and who signs off?', 'commercial', 'one merchant project owner, to be nominated', 'merchant'),
    ('merchant_data_requirements', 'MERCHANT_DATA', 'What merchant data must be collected before configuration?', 'operations', 'branch list, staff roster and POS terminal inventory', 'merchant'),
    ('merchant_acceptance_criteria', 'MERCHANT_ACCEPTANCE', 'What must be true for the merchant to accept the delivery?', 'commercial', 'offers live and points accruing correctly in every branch', 'merchant'),
    ('merchant_legal_requirements', 'MERCHANT_LEGAL', 'What legal, privacy or compliance obligations apply?', 'commercial', 'standard data-protection terms, specifics to be confirmed', 'merchant'),
    ('merchant_support_model', 'MERCHANT_SUPPORT', 'Who supports merchant staff after go-live, and through what channel?', 'operations', 'provider support desk during business hours', 'merchant'),
    ('training_required', 'TRAINING_REQUIRED', 'Is on-ground staff training in scope for the provider?', 'operations', 'yes, the provider delivers on-ground training', 'merchant'),
    ('training_sessions', 'TRAINING_SESSIONS', 'How many training sessions are delivered, and per what?', 'operations', '2 sessions per location', 'merchant'),
    ('training_audience', 'TRAINING_AUDIENCE', 'Who attends training, and how many people?', 'operations', 'merchant operations and till staff', 'merchant'),
    ('training_topics', 'TRAINING_TOPICS', 'What must training cover?', 'operations', 'enrolment, points accrual, redemption and error handling', 'merchant'),
    ('training_location', 'TRAINING_LOCATION', 'Where does training take place: on site, remote, or both?', 'operations', 'on site at each merchant location', 'merchant'),
    ('expected_trade_volume', 'TRADE_VOLUME', 'How many live transactions are expected, and over what period?', 'operations', 'not stated', 'merchant'),
    ('monitoring_requirements', 'MONITORING', 'What must be monitored in production, and who watches it?', 'operations', 'transaction success rate and API availability, watched by the provider', 'project'),
    ('security_requirements', 'SECURITY', 'What security or compliance standards must the integration meet?', 'technical', 'TLS in transit, credentials held in a secret store', 'project'),
]

# The default roster (title, team, responsibility, is_lead), in order.
ROSTER = [
    ("Commercial Manager", "commercial", "Contract, pricing and commercial terms", True),
    ("Account Manager", "commercial", "Merchant relationship and offer sign-off", False),
    ("Business Development Manager", "commercial", "Merchant acquisition and deal scoping", False),
    ("Legal Advisor", "commercial", "Contract review, legal and compliance requirements", False),
    ("Technical Lead", "technical", "Integration architecture and technical sign-off", True),
    ("Backend Engineer", "technical", "API development, points logic and integrations", False),
    ("Frontend Engineer", "technical", "Merchant and customer-facing interfaces", False),
    ("AI Engineer", "technical", "Models, extraction and intelligent features", False),
    ("QA Engineer", "technical", "Test cases, validation and acceptance testing", False),
    ("DevOps Engineer", "technical", "Infrastructure, deployment and environments", False),
    ("Operations Manager", "operations", "Configuration, go-live and operational readiness", True),
    ("Operations Specialist", "operations", "System, merchant and offer configuration", False),
    ("Merchant Success Specialist", "operations", "Merchant onboarding and on-ground training", False),
    ("Support Agent", "operations", "Post-go-live support and incident handling", False),
    ("Deployment Specialist", "operations", "Release coordination and go-live execution", False),
]

# Words too common in titles to identify a role.
GENERIC_ROLE_WORDS = [
    "manager", "engineer", "specialist", "lead", "agent", "advisor", "officer", "developer", "team",
]

# What people write -> what the roster calls it.
ROLE_SYNONYMS = {
    "dev": "engineer", "developer": "engineer", "programmer": "engineer",
    "tester": "qa", "testing": "qa", "quality": "qa",
    "sre": "devops", "infrastructure": "devops", "infra": "devops", "platform": "devops",
    "architect": "technical", "ops": "operations", "operational": "operations",
    "bd": "business", "lawyer": "legal", "counsel": "legal", "compliance": "legal",
    "onboarding": "success", "training": "success", "trainer": "success",
    "ui": "frontend", "ux": "frontend", "web": "frontend",
    "api": "backend", "server": "backend", "ml": "ai", "llm": "ai",
    "release": "deployment", "deploy": "deployment", "helpdesk": "support",
}

# Words that put somebody on the client's side.
CLIENT_SIDE_WORDS = [
    "merchant", "customer", "shopper", "client", "store", "branch", "cashier", "till", "retail", "end",
]

# Points for a shared distinctive and a shared generic word.
DISTINCTIVE_POINTS, GENERIC_POINTS = 10, 1

# Wording that defers an answer, and wording that is vague without a number.
DEFERRING_MARKERS = [
    "tbd", "to be confirmed", "to be agreed", "to be determined", "to be provided",
    "to be defined", "not stated", "not specified", "unspecified", "unknown", "n/a",
]
HEDGE_WORDS = ["standard", "typical", "usual", "probably", "likely", "approximately"]

# Confidence of an assumption by category, else the default.
CONFIDENCE_BY_CATEGORY = {"SCHEDULE": 0.6, "TEAM_SIZE": 0.5, "PERFORMANCE": 0.5, "SLA_TARGETS": 0.5}
DEFAULT_CONFIDENCE = 0.7

TEAMS = ["commercial", "technical", "operations"]
SCOPES = ["merchant", "offer", "project"]

# The team that owns each category of enumerated detail.
CATEGORY_TEAMS = {
    "merchant": "commercial",
    "offer": "commercial",
    "contract": "commercial",
    "pricing_term": "commercial",
    "sla": "commercial",
    "legal_requirement": "commercial",
    "approval": "commercial",
    "commercial_milestone": "commercial",
    "api": "technical",
    "integration": "technical",
    "authentication": "technical",
    "data_requirement": "technical",
    "security_requirement": "technical",
    "performance_requirement": "technical",
    "infrastructure_requirement": "technical",
    "system_operation": "operations",
    "system_configuration": "operations",
    "onboarding_step": "operations",
    "training_topic": "operations",
    "merchant_trade": "operations",
    "go_live_support": "operations",
    "post_go_live_support": "operations",
}

# Whole words that signal a team.
TEAM_SIGNALS = {
    "commercial": [
        "contract", "pricing", "sign-off", "signature", "commercial terms", "revenue share", "sla",
    ],
    "technical": [
        "api", "integration", "endpoint", "authentication", "authorisation flow", "engine",
        "calculation", "accrual logic", "schema", "deploy", "code", "unit test", "end-to-end test",
    ],
    "operations": [
        "training", "onboard", "merchant configuration", "store configuration",
        "configure the merchant", "go-live", "hypercare", "rollout",
    ],
}

# Keyword areas of the evaluation, and terms that must not be asserted per gap.
COVERAGE_AREAS = {
    "contract": ["contract", "countersign", "sign"],
    "offers": ["offer"],
    "api_integration": ["api", "integration", "pos"],
    "points_logic": ["point", "accrual", "earn", "expiry"],
    "testing": ["test", "validation", "qa"],
    "configuration": ["configur", "setup", "provision"],
    "onboarding": ["onboard", "merchant account"],
    "training": ["train"],
    "go_live": ["go-live", "golive", "launch", "cutover"],
}
FORBIDDEN_TERMS = {
    "offer_count": ["20 offers", "12 offers", "15 offers"],
    "earn_rate": ["10 points", "5 points"],
    "training_duration": ["2 days", "3 days", "two days"],
    "team_size": ["8 people", "5 technical"],
}

# The columns of a board that belong to a team.
TEAM_LISTS = ["Commercial", "Technical", "Operations"]

# Label colours.
LABEL_COLOURS = {
    "TEAM-COMMERCIAL": "blue", "TEAM-TECHNICAL": "purple", "TEAM-OPERATIONS": "orange",
    "FROM-SOW": "sky", "INFERRED": "sky", "ASSUMED": "pink", "SOURCE-UNKNOWN": "black",
    "GROUNDED": "green", "REVIEW-REQUIRED": "yellow", "GROUNDING-FAILED": "red", "NOT-CHECKED": "black",
}


#: Last line of every card.
CARD_FOOTER = "_Managed by the plan. Full traceability lives there._"


def checklist(spark: SparkSession) -> DataFrame:
    rows = [(i, *row) for i, row in enumerate(CHECKLIST, start=1)]
    return spark.createDataFrame(
        rows,
        "field_ord int, field_key string, category string, question string, team string, "
        "default_value string, scope string",
    )


def roster(spark: SparkSession) -> DataFrame:
    rows = [(i, *row) for i, row in enumerate(ROSTER, start=1)]
    return spark.createDataFrame(
        rows, "role_ord int, role_title string, team string, responsibility string, is_lead boolean"
    )


def detail_categories(spark: SparkSession) -> DataFrame:
    rows = list(CATEGORY_TEAMS.items())
    return spark.createDataFrame(rows, "category string, team string")
