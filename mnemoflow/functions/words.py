"""Fixed word lists, stated as they must be for equal results."""

# Words that the router's tokens leave out.
ROUTER_STOP = """
the a an and or but of to for in on at by with
is are was were be been being do does did have has had
what when where why how which who whom this that these those
i we you they it as if then else from into about us
our your their my me him her them will would could
should shall may might can make made
""".split()

# Words that bridge terms leave out.
BRIDGE_STOP = """
about after again also answer before being could does from have into
only question that their there this using what when where which with
""".split()

# Words that content terms leave out.
CONTENT_STOP = """
about across after again also answer before being between could different does from give
handle handled have into many mentioned only provide question related should state that
their there this using what when where which with would
""".split()

# Terms that count as strong evidence.
HIGH_SIGNAL = ["api", "api key", "csrf", "flask-wtf", "ga4", "lockout", "operationalerror", "pbkdf2", "redis", "sha256", "unique", "constraint", "uuid", "wireframe"]

# Terms that a trigger adds.
SYNONYMS = {
    "security": ["auth", "authentication", "password", "hash", "csrf", "flask-wtf", "session", "login", "lockout", "redis", "role", "https"],
    "database": ["sqlite", "sqlalchemy", "postgres", "transaction", "migration", "table", "schema", "constraint", "uuid", "operationalerror"],
    "weather": ["openweather", "temperature", "humidity", "conditions", "autocomplete", "cors", "forecast", "api", "rate", "cache"],
    "performance": ["lazy", "loading", "load", "latency", "bounce", "analytics", "ga4", "tracking"],
}
