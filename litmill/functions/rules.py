"""Rule tables of the engine: word lists, phrase patterns and templates that results depend on."""

from __future__ import annotations

# Stop words of query terms.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "in",
    "is", "it", "of", "on", "or", "that", "the", "to", "with", "without", "via",
    "we", "our", "their", "his", "her", "its", "this", "these", "those", "can",
    "may", "might", "should", "would", "could", "what", "which", "when", "where",
    "who", "whom", "why", "how", "about", "into", "over", "under", "between",
)

# Further stop words of article queries.
ACADEMIC_WORDS = (
    "paper", "study", "show", "shows", "shown", "result", "results",
    "section", "figure", "table", "model", "models", "approach",
    "method", "methods", "using", "used", "also", "however",
    "thus", "therefore", "since", "while", "within", "across",
    "based", "propose", "proposed", "analysis", "present",
    "consider", "considered", "provide", "provides", "given",
    "find", "finds", "found", "well", "both", "each", "such",
    "more", "than", "that", "they", "them", "then", "when",
    "were", "been", "have", "here", "there", "first", "second",
    "third", "case", "cases", "form", "forms", "type", "types",
    "term", "terms", "often", "most", "many", "some", "other",
    "others", "further", "new", "known", "main", "large", "small",
    "high", "low", "general", "specific", "important", "key",
)

# Query expansion, in the order in which the rules apply.
EXPANSIONS = (
    ("mechanism design", ("incentive compatibility", "strategyproof", "revelation principle", "allocation", "mechanism")),
    ("auction", ("bidding", "reserve price", "mechanism design", "optimal auction")),
    ("information design", ("bayesian persuasion", "signaling", "disclosure", "information structure")),
    ("persuasion", ("information design", "bayesian persuasion", "signaling")),
    ("contract theory", ("principal agent", "moral hazard", "adverse selection", "incentive")),
    ("moral hazard", ("principal agent", "incentive", "hidden action")),
    ("adverse selection", ("principal agent", "hidden information", "screening")),
    ("screening", ("adverse selection", "menu", "self selection")),
    ("matching", ("market design", "stable matching", "two-sided")),
    ("public goods", ("free riding", "lindahl", "provision")),
    ("multi-item", ("bundling", "menu", "allocation")),
    ("dynamic", ("intertemporal", "sequential")),
    ("bayesian", ("beliefs", "posterior", "prior")),
    ("signaling", ("information design", "bayesian persuasion")),
    ("contract", ("principal agent", "incentive", "screening")),
)

# Academic phrase patterns.
PHRASES = (
    r"(we (show|demonstrate|prove|establish|argue|claim|conjecture|hypothesize) that)",
    r"(it (follows|is clear|can be shown|is evident|is straightforward|is easy to see|is immediate|turns out) that)",
    r"((this|the above|these results?) (implies?|suggests?|indicates?|shows?|reveals?|establishes?) that)",
    r"((implies|suggests|indicates) that)",
    r"(consistent with (the hypothesis|our results|the prediction))",
    r"(support (for|of) the (hypothesis|theory|claim|view))",
    r"(reasoning (suggests|implies) that)",
    r"(in (support|favor) of)",
    r"(argue (that|for|against))",
    r"(evidence (suggests|indicates|shows|supports))",
    r"(in contrast|by contrast|on the other hand|conversely|alternatively)",
    r"(moreover|furthermore|in addition|additionally|also|equally important)",
    r"(however|nevertheless|nonetheless|yet|but|still|even so)",
    r"(therefore|thus|hence|consequently|as a result|it follows that|accordingly)",
    r"(intuitively|roughly speaking|loosely speaking|to see why|the intuition is)",
    r"(observe that|note that|notice that|recall that|importantly)",
    r"(the (key|main|crucial|central|critical|essential) (insight|observation|point|idea) is)",
    r"(as (we|one) (will|shall) see|as (shown|discussed|argued) (below|above|later))",
    r"(in this (paper|section|chapter|note|article)|the rest of (the paper|this section))",
    r"(the (main|key|central|primary) (result|contribution|finding|insight|theorem))",
    r"(we (first|then|next|finally|now|begin by|proceed to) (consider|examine|analyze|turn to|discuss|study))",
    r"(the (following|next|subsequent) (proposition|theorem|lemma|corollary|result|claim))",
    r"(section \\d+ (discusses|presents|analyzes|introduces|develops|contains))",
    r"(the paper is organized as follows|the remainder of the paper|we organize the paper)",
    r"(before proceeding|before (we|turning to)|to (set up|fix ideas|establish notation))",
    r"(we (now|next) (present|state|derive|prove)|turning (now )?to|we are ready to)",
    r"(let|define|denote|suppose|assume|consider) [\w\s]+ (be|as|to be)",
    r"(we (say|call) that|is (said|called) to be|is defined (as|to be))",
    r"(without loss of generality|w\.?l\.?o\.?g\.?)",
    r"(formally|more precisely|to be precise|specifically|in particular)",
    r"(we (write|use|adopt) (the )?notation|by (abuse of|slight abuse of) notation)",
    r"(the set of all|the space of|the collection of|the class of)",
    r"(for (any|all|each|every|some) \w+|for \w+ (sufficiently|large|small))",
    r"(where \w+ (denotes|represents|is|stands for))",
    r"(the (optimal|equilibrium|efficient|unique|first-best|second-best) (mechanism|allocation|outcome|contract|policy))",
    r"(there exists (a|an|the)?\s?(unique|optimal|efficient|equilibrium)?)",
    r"(if and only if|necessary and sufficient|iff)",
    r"(in (a|the|any) (Nash|Bayesian|Perfect|Sequential|Subgame|Markov) equilibrium)",
    r"(characterizes|characterizing|the characterization|fully characterizes|completely characterizes)",
    r"(is (strictly|weakly)? (increasing|decreasing|monotonic|convex|concave) in)",
    r"(the (unique|only) (equilibrium|solution|mechanism|allocation))",
    r"(admits (a|an) (unique|efficient|closed-form) (solution|characterization))",
    r"(incentive (compatible|compatibility|constraints?)|IC (constraint)?)",
    r"(individual(ly)? rational(ity)?|participation constraint|IR (constraint)?)",
    r"(first|second) order (condition|stochastic dominance|approach)",
    r"(utility|payoff|profit|welfare|surplus) (function|maximization|maximizing)",
    r"(single( |-)crossing|monotone likelihood ratio|MLRP|assortative matching)",
    r"(information (structure|design|asymmetry|rent)|private information|private type)",
    r"(mechanism (design|designer|problem)|principal(-| )agent|moral hazard|adverse selection)",
    r"(revelation principle|direct mechanism|incentive (feasible|feasibility))",
    r"(implementable|implementation|implements the|implement(s|ing) the)",
    r"(social (welfare|planner|choice)|Pareto (efficient|optimal|improvement|frontier))",
    r"(ex (ante|interim|post)|before|after) (realization|learning|observing)",
    r"(common (knowledge|prior|belief)|public (information|signal|belief))",
    r"(cheap talk|signaling|screening|communication|disclosure)",
    r"(virtual (utility|surplus|valuation)|information rent|rent extraction)",
    r"(envelope (theorem|condition|formula)|marginal (type|agent))",
    r"(ironing|bunching|pooling|separating|semi-separating)",
    r"(bang-bang|corner solution|interior solution|binding constraint)",
    r"(Bayesian persuasion|information design|signal(ing|s)?)",
    r"(sender|receiver|designer|principal|agent|informed( party)?|uninformed( party)?)",
    r"(posterior (belief|distribution|expectation)|prior (belief|distribution))",
    r"(concavification|concave closure|convexification)",
    r"(obedience (constraint|condition)|incentive (of|for) (the )?(receiver|agent))",
    r"(full (disclosure|revelation|information)|no (disclosure|information))",
    r"(partial (disclosure|revelation|pooling)|information (partition|structure))",
    r"(value of information|informational (content|value)|Blackwell (ordering|informativeness))",
    r"(commitment (power|assumption)|credible|credibility)",
    r"(persuasion (problem|setting|game)|sender's (problem|objective|payoff))",
    r"(receiver's (action|decision|best response)|optimal (action|decision))",
    r"(signal (realization|structure|space)|experiment|test)",
    r"(splitting|garbling|mean-preserving spread|Bayes plausible|martingale)",
    r"(moral hazard|hidden (action|effort|information)|unobservable (effort|action))",
    r"(adverse selection|hidden (type|characteristic)|private (type|information))",
    r"(first-best|second-best|third-best|constrained (efficient|optimal))",
    r"(limited liability|wealth constraint|budget constraint)",
    r"(risk (averse|neutral|loving)|risk (sharing|allocation))",
    r"(complete (contract|contracting)|incomplete (contract|contracting))",
    r"(hold-up (problem)?|renegotiation|commitment (problem)?)",
    r"(screening (contract|mechanism)|menu of contracts|nonlinear (pricing|tariff))",
    r"(observ(able|ability)|verifi(able|ability)|contractible)",
    r"(with probability (one|zero|\d|\w+)|almost surely|a\.s\.)",
    r"(in expectation|expected (value|utility|payoff)|E\[)",
    r"(conditional (on|expectation|probability|distribution))",
    r"(Bayes('|'s)? (rule|theorem|formula|updating)|Bayesian (updating|inference))",
    r"(belief (updating|formation|consistency)|consistent beliefs)",
    r"(distribution (over|of)|distributed (according to|as))",
    r"(random (variable|vector|process)|stochastic)",
    r"(independence|independent (of|and identically)|i\.i\.d\.)",
    r"(compared (to|with)|relative to|in comparison (with|to))",
    r"(outperforms|dominates( strictly)?|is (superior|inferior) to)",
    r"(benchmark (case|model)|baseline|standard model)",
    r"(special case|limiting case|as a (limiting|special) case)",
    r"(generalizes|extends|nests|subsumes|encompasses)",
    r"(reduces to|collapses to|coincides with|is equivalent to)",
    r"(little is known about|remains an open question|less attention has been paid)",
    r"(fills this gap|addresses this (issue|gap)|bridges the gap)",
    r"(differs from|unlike|contrary to|in contrast with) [\w\s]+",
    r"(contributes to the literature|builds on|extends (the model of|the work of|the results of))",
    r"(related (literature|work|papers)|the literature on|a growing (literature|body of work))",
    r"(pioneered by|following|in the spirit of|builds upon)",
    r"(has (received|attracted) (considerable|much|significant) attention|well-studied|extensively studied)",
    r"(new (to|in) the literature|first to (show|characterize|study))",
    r"(we (employ|adopt|utilize|use|apply|develop) (a|the|an) (model|framework|approach|technique|method))",
    r"(our (model|framework|setup|approach) (captures|allows for|incorporates|features|accommodates))",
    r"(solving|maximizing|minimizing) the (problem|program|objective|optimization)",
    r"(proof (is in|provided in|appears in|relegated to) (the )?appendix)",
    r"(taking (the )?derivative|first-order (condition|derivative)|FOC)",
    r"(by (backward )?induction|using (standard |straightforward )?arguments)",
    r"(closed-form (solution|expression|characterization)|analytical solution)",
    r"(sufficient (conditions?|statistics?)|necessary (conditions?|requirements?))",
    r"(limitations of|restricted to|focuses only on|confines attention to)",
    r"(leave (for|to) future (research|work)|promising (direction|avenue)|future (work|research))",
    r"(beyond the scope of|does not (address|cover|include|consider))",
    r"(abstrac(t|ting) (from|away)|for (simplicity|tractability)|simplifying assumption)",
    r"(natural (extension|generalization|direction)|interesting (extension|question))",
    r"(robustness (check|analysis)|sensitivity (analysis|to))",
    r"(for (all|any|each|every) \w+ (such that|satisfying|with))",
    r"(there (exists|exist) (a|an)?\s?\w+\s?(such that)?)",
    r"(is (bounded|finite|countable|measurable|continuous|differentiable))",
    r"(converges (to|in)|convergence|limiting (behavior|distribution))",
    r"((strictly|weakly) (positive|negative|greater|less|increasing|decreasing))",
    r"(supremum|infimum|maximum|minimum|argmax|argmin)",
)

# Categories of phrase patterns, the first whose word the pattern holds.
CATEGORIES = (
    ("Econ/Game Theory", ("incentive", "rationality", "condition", "utility", "payoff", "profit", "crossing", "monotone", "matching", "information", "mechanism", "principal", "agent", "moral", "adverse", "risk", "belief", "posterior", "prior", "strategy", "nash", "bayes", "equilibrium", "allocation", "surplus", "welfare")),
    ("Argumentation", ("show", "demonstrate", "prove", "argue", "claim", "establish", "propose", "suggest", "implies", "indicates")),
    ("Contrast", ("contrast", "however", "nevertheless", "yet", "conversely", "unlike", "differs")),
    ("Conclusion", ("therefore", "thus", "hence", "consequently", "result", "follows")),
    ("Addition", ("moreover", "furthermore", "addition")),
    ("Definition/Setup", ("let", "define", "denote", "suppose", "assume", "consider")),
    ("Structure", ("paper", "section", "contribution", "finding", "organized")),
    ("Results", ("optimal", "exists", "unique", "efficient", "necessary", "outcome", "solution")),
    ("Motivation/Gap", ("gap", "question", "attention", "fills", "contributes", "extends")),
    ("Methodology", ("employ", "adopt", "utilize", "model", "framework", "solving", "proof", "appendix")),
    ("Limitations/Future", ("limitations", "scope", "future", "extensions")),
)
OTHER_CATEGORY = "General Academic"

# Sentence templates (pattern at the start of a sentence, name), the first that matches.
TEMPLATES = (
    (r"^(In this|This) (paper|section|article|chapter),? we ", "[INTRO] we [ACTION]"),
    (r"^The (main|key|central|primary) (result|contribution|finding|insight) is ", "[INTRO] The [ADJ] [NOUN] is [CLAIM]"),
    (r"^The paper is organized as follows", "[INTRO] Roadmap"),
    (r"^(We|This paper) contributes? to (the literature|two strands)", "[LIT] Contribution"),
    (r"^(Consider|Suppose|Assume) (a|an) (model|economy|setting|environment) ", "[MODEL] Setup start"),
    (r"^Let \[latex\].+\[\/latex\] denote ", "[MODEL] Notation"),
    (r"^Let \w+ (denote|be) ", "[MODEL] Let [VAR] [DEF] [OBJECT]"),
    (r"^(The )?(agent|principal|player) (observes|chooses|maximizes) ", "[MODEL] Agent Action"),
    (r"^(Preferences|Utility) (are|is) (given by|defined as) ", "[MODEL] Utility Definition"),
    (r"^Time is (discrete|continuous) ", "[MODEL] Time Structure"),
    (r"^(However|Nevertheless|Nonetheless), ", "[LOGIC] [CONTRAST], [COUNTERPOINT]"),
    (r"^(Moreover|Furthermore|In addition|Additionally), ", "[LOGIC] [CONNECTOR], [EXTENSION]"),
    (r"^(Therefore|Thus|Hence|Consequently|It follows that), ", "[LOGIC] [CONCLUSION], [RESULT]"),
    (r"^(If|When|Whenever) .+ then ", "[LOGIC] [CONDITION] then [CONSEQUENCE]"),
    (r"^(It is|It can be) (easy|straightforward|immediate) to (see|show|verify) ", "[LOGIC] It is [ADJ] to [VERB] [CLAIM]"),
    (r"^The (optimal|equilibrium|unique|first-best) (mechanism|contract|policy|allocation) ", "[RESULT] The [QUALIFIER] [SOLUTION]"),
    (r"^(In equilibrium|At the optimum),? ", "[RESULT] [STATE], [PROPERTY]"),
    (r"^(Proposition|Theorem|Lemma|Corollary) \d+ ", "[RESULT] Formal Statement"),
    (r"^(Proof|The proof) (is|appears|can be found) in ", "[META] Proof Location"),
    (r"^(Incentive compatibility|IC) (implies|requires|constraint) ", "[ECON] IC Constraint"),
    (r"^(Individual rationality|Participation) (implies|requires|constraint) ", "[ECON] IR Constraint"),
    (r"^The (revelation principle|envelope theorem) ", "[ECON] Core Principle"),
    (r"^(Under|Subject to) (information|asymmetric) ", "[ECON] Information Structure"),
    (r"^(Note|Notice|Observe|Recall) that ", "[DISC] [ATTENTION] that [FACT]"),
    (r"^(Intuitively|Roughly speaking|To see why),? ", "[DISC] [INTUITION], [EXPLANATION]"),
    (r"^(Unlike|In contrast to) ", "[DISC] Comparison"),
)

# Words that mark a sentence as publisher's boilerplate.
JUNK_WORDS = (
    "preprint", "copyedited", "doi", "downloaded", "personal use", "copyright",
    "http", "www.", "vol.", "no.", "pp.", "issn", "isbn", "url", "email",
    "university", "press", "journal", "review", "accepted", "submitted",
    "resubmitted", "forthcoming", "manuscript", "online", "access", "license",
)

# At least one of these stands among the first three words of a counted sentence start.
STARTER_WORDS = (
    "the", "in", "on", "at", "we", "this", "it", "there", "to", "of", "and", "for", "as", "by", "an", "a",
    "result", "results", "figure", "table", "section", "proof", "lemma", "theorem", "proposition",
    "if", "when", "given", "note", "recall", "consider", "suppose", "let", "define", "assume",
    "here", "first", "second", "finally", "moreover", "however", "furthermore", "therefore",
    "thus", "hence", "clearly", "intuitively", "interestingly", "similarly",
    "our", "my", "these", "those", "such", "all", "some", "any", "each", "every",
)

# Words that count as true, and statuses of tasks in display order.
TRUE_WORDS = ("1", "true", "yes", "y", "on")
STATUSES = ("pending", "running", "completed", "failed", "cancelled")


#: Words of lines that are no title, and what ends the search for one.
TITLE_JUNK = (
    "arxiv", "issn", "vol.", "no.", "downloaded", "http", "pii:", "copyright", "available at", "elsevier", "sciencedirect", "www.", "doi:", "received", "accepted", "published", "online", "open access",
    "working paper", "discussion paper", "series", "journal", "reproduction", "rights reserved", "commercial re-use", "permissions", "original unedited manuscript", "downloaded from", "https://",
    "university", "universite", "universit", "department", "school ", "institute", "laborator",
)
TITLE_STOPS = ("abstract", "introduction")
