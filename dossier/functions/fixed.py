"""Word lists and patterns that results depend on literally."""

# Names of sections and the headings that open them.
SECTIONS = {
    "contact": ["details", "contact details", "personal details", "contact info", "personal info", "contact information", "links", "social links", "social profiles", "websites & social links"],
    "summary": ["summary", "professional summary", "executive summary", "career summary", "profile", "professional profile", "about", "about me", "objective", "career objective", "professional objective", "summary of qualifications", "overview", "personal statement"],
    "experience": ["experience", "work experience", "professional experience", "employment history", "work history", "career history", "professional background", "relevant experience", "internships", "internship experience", "employment", "work background"],
    "education": ["education", "academic background", "academic history", "educational qualifications", "qualifications", "academic qualifications", "degrees", "education and training", "studies", "courses & education"],
    "skills": ["skills", "technical skills", "core competencies", "key skills", "skills & expertise", "skills and expertise", "technologies", "tech stack", "tools & technologies", "technical proficiency", "programming skills", "areas of expertise", "competencies", "skills & abilities", "professional skills"],
    "projects": ["projects", "key projects", "personal projects", "academic projects", "technical projects", "portfolio projects", "notable projects", "selected projects", "open source projects"],
    "certifications": ["certifications", "certificates", "licenses", "professional certifications", "licenses & certifications", "courses & certifications", "accreditations"],
    "languages": ["languages", "known languages", "language proficiency", "languages spoken"],
    "hobbies": ["hobbies", "interests", "activities", "personal interests", "extra-curricular activities", "hobbies & interests"],
    "awards": ["awards", "honors", "achievements", "awards & achievements", "honors and awards", "accomplishments"],
    "publications": ["publications", "research publications", "papers", "patents"],
}

# Characters.
BULLETS = "•‣◦⁃∙○●▪▫■□◆◇▸▹➢➤✅✔✓–—·*°º"
EDGE = " -•*|·°º\t"
EDGE_COMMA = EDGE + ","
ITEM_EDGE = " -*()[]{}:.,°º\t"
ITEM_SPLIT = "[,|\\n\\t;•·/°º]+"

# Lines that cleaning removes.
PAGE_LINES = [
    r"(?im)^\s*page\s+\d+\s*(?:of|/)\s*\d+\s*$",
    r"(?im)^\s*page\s+\d+\s*$",
    r"(?m)^\s*\d+\s*/\s*\d+\s*$",
    r"(?im)^\s*\d+\s+of\s+\d+\s*$",
    r"(?m)^\s*[-—–]\s*\d+\s*[-—–]\s*$",
    r"(?im)^\s*\[?\s*page\s*\d+\s*\]?\s*$",
]
DIVIDER_LINES = r"(?m)^\s*[-=_~*#]{3,}\s*$"

# Contact patterns.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?:(?:\+|00)\d{1,3}[\s.-]*)?(?:\(?\d{2,4}\)?[\s.-]*)?\d{3,4}[\s.-]*\d{3,4}(?:[\s.-]*\d{1,4})?|\b\d{10,12}\b"
LINKEDIN = r"(?i)(?:https?://)?(?:www\.)?linkedin\.com/(?:in|pub)/[a-zA-Z0-9_-]+/?"
GITHUB = r"(?i)(?:https?://)?(?:www\.)?github\.com/[a-zA-Z0-9_-]+/?"
URL = r"(?i)https?://(?:www\.)?[-a-zA-Z0-9@:%._+~#=]{1,256}\.[a-zA-Z0-9()]{2,6}\b(?:[-a-zA-Z0-9()@:%_+.~#?&/=]*)"
MAIL_HOSTS = ["gmail.com", "yahoo.com", "outlook.com", "hotmail.com"]

# Words that are no part of a person's name.
NOT_NAMES = [
    "resume", "curriculum", "vitae", "cv", "page", "email", "phone", "contact", "address", "profile", "summary",
    "experience", "education", "skills", "portfolio", "github", "linkedin", "engineer", "developer", "manager", "lead",
    "architect", "analyst", "scientist", "consultant", "student", "intern", "software", "frontend", "backend",
    "fullstack", "full-stack", "security", "guard", "officer", "details", "links", "hobbies", "languages", "place",
    "birth", "driving", "license", "full", "male", "female", "married", "single", "nationality", "references",
    "available", "request", "career", "objective", "employment", "history", "academic", "background", "qualifications",
    "professional", "interests", "activities", "certifications", "certificates", "notable", "projects", "selected",
    "overview", "statement", "expertise", "competencies", "work", "studies", "awards", "honors", "publications",
]

# Dates.
MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
DATE = rf"\b(?:{MONTH}\.?,?\s+)?(?:19|20)\d{{2}}\b"
DATE_RANGE = rf"\b(?:{MONTH}\.?,?\s+)?(?:19|20)\d{{2}}\s*(?:[-–—to/]+\s*(?:(?:{MONTH}\.?,?\s+)?(?:19|20)\d{{2}}|Present|Current|Now|Till Date))\b"

# Keywords, tested as substrings.
COLLEGES = ["university", "institute", "college", "school of", "academy", "polytechnic", "campus", "faculty", "iit", "nit", "bits", "mit", "stanford", "harvard", "berkeley", "oxford", "cambridge", "foundation", "asis", "training"]
DEGREES = ["bachelor", "master", "doctor", "phd", "b.tech", "m.tech", "b.sc", "m.sc", "bba", "mba", "program", "programme", "certificate", "certification", "training", "diploma", "associate", "degree", "cpop", "socp", "cpo"]
JOBS = [
    "engineer", "developer", "architect", "scientist", "manager", "lead", "director", "analyst", "consultant",
    "designer", "intern", "associate", "administrator", "specialist", "officer", "head", "vp", "programmer", "founder",
    "co-founder", "cto", "ceo", "cpo", "owner", "guard", "security", "agent", "investigator", "technician", "inspector",
    "coordinator", "assistant", "supervisor", "representative", "practitioner", "attendant", "operator", "counselor",
    "nurse", "teacher", "advisor",
]
FIRMS = ["inc", "corp", "technologies", "solutions", "services", "llc", "ltd", "security"]
COURSE_LINE = r"(?i)^[-•*|·°º\t\s]*(?:course\s*curriculum|curriculum|coursework|courses|relevant\s*courses|major|gpa|grade|thesis|project|description|modules|focus)\b"
DEGREE_PHRASES = r"(?i)(?<![\w.])(?:b\.?tech|m\.?tech|b\.?e|m\.?e|b\.?sc|b\.?s|m\.?sc|m\.?s|b\.?a|m\.?a|b\.?c\.?a|m\.?c\.?a|b\.?b\.?a|m\.?b\.?a|ph\.?d|b\.?com|m\.?com|cpo|cpop|socp|(?:bachelor|master) of .+|(?:bachelor'?s|master'?s) in .+|(?:bachelor's|master's) degree.*|doctor of philosophy|associate degree|diploma in .+)\.?(?!\w)"

# How title and company, or degree and institution, are separated, in order.
TITLE_SEPARATORS = [r"(?i)\s+at\s+", r"\s+@\s+", r"\s*[-–—|]\s*", r"\s{2,}|\t+", r"\s*,\s*"]
DEGREE_SEPARATORS = [r"\s*[-–—|]\s*", r"(?i)\s+at\s+", r"\s*,\s*"]
BULLET_STARTS = "-•*·°º—–>"
SHORT_BULLET_STARTS = "-•*·°º"

# Phrases that are headings rather than skills.
NOT_SKILLS = [
    "skills", "experience", "education", "summary", "projects", "certifications", "languages", "hobbies", "awards",
    "profile", "details", "contact", "about", "history", "employment", "academic", "background", "qualifications",
    "competencies",
]

# Display names of skill categories.
CATEGORY_NAMES = {
    "Programming Languages": "LANGUAGES",
    "Web & Frontend": "FRAMEWORKS & FRONTEND",
    "Backend Frameworks": "FRAMEWORKS & BACKEND",
    "Databases": "DATABASES & STORAGE",
    "Cloud & DevOps": "CLOUD & DEVOPS",
    "Data Science & AI": "AI & DATA SCIENCE",
    "Big Data": "BIG DATA & ANALYTICS",
    "Data Visualization & BI": "DATA VISUALIZATION",
    "Security & Law Enforcement": "SECURITY & LAW",
    "Security & Defense": "SECURITY & DEFENSE",
    "Security & Operations": "OPERATIONS & COMPLIANCE",
    "Methodologies": "METHODOLOGIES",
    "Testing & QA": "TESTING & QA",
    "Tools & Version Control": "TOOLS & SYSTEMS",
}
OTHER_CATEGORY = "CORE SKILLS & EXPERTISE"
UNKNOWN_CATEGORY = "Other Competencies"

# What is shown for a missing field.
DEFAULTS = {"name": "Candidate Profile", "title": "Position", "company": "Company", "dates": "Present", "degree": "Degree", "institution": "University", "project": "Project", "top_title": "Senior Professional"}
NO_NAMES = ["Candidate Profile", "Not Specified", "Candidate Name"]
