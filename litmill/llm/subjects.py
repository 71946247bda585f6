"""Subject area of each document.

Curated terms of each subject, in three languages and with weights, are matched by one multi-pattern
automaton. A sentence of running text supports the subjects whose terms it holds; headings, tables,
captions, keyword lists, formulas and references are not running text. A term counts by its weight
times its rarity in the whole corpus, so one that occurs nearly everywhere says little. Words that
several subjects use in senses of their own support a subject only beside sentences that are
certainly about it. A subject is assigned where its support, and its share of the document, pass
thresholds calibrated on hand-labelled documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmill.session import checkpoint, distinct_names

#: Weights: a phrase of several words names its subject; a single noun nearly does.
PHRASE, NOUN = 1.0, 0.8

#: Least supporting sentences, of them certain ones, and least share of the sentences with any subject.
#: Calibrated on subject_labels of the test data (README).
SUPPORT, CERTAIN, SHARE = 1.9, 0.75, 0.08

#: Curated terms. First phrases, then nouns (all with their plurals), then German and Spanish terms.
PHRASES = {
    "biology": "avian migration, bacterial colonies, cell membranes, chromatin states, embryonic tissue, enzyme kinetics, gene expression, genome assemblies, host parasites, larval growth, mitochondrial genes, mutation rates, photosynthetic rates, pollinator visits, predator densities, protein folding, reef fishes, root systems, seed dispersal, soil microbes",
    "machine_learning": "active learning, attention layers, batch normalisation, contrastive objectives, decision forests, domain adaptation, feature embeddings, generative samplers, gradient descent, held-out accuracy, hyperparameter search, kernel machines, label noise, model distillation, neural classifiers, random initialisation, regularised regression, reinforcement policies, representation learning, training loss",
    "economics": "adverse selection, bidder valuations, collusive bidding, consumer surplus, credit rationing, demand elasticity, household savings, labour supply, matching markets, monetary policy, moral hazard, oligopoly pricing, price discrimination, public procurement, reserve prices, sealed-bid auctions, second-price rules, tax incidence, trade tariffs, wage bargaining",
    "medicine": "antibiotic courses, blood pressure, cardiac arrest, chemotherapy doses, chronic pain, clinical remission, diagnostic imaging, hospital readmission, insulin therapy, nursing care, patient survival, placebo groups, postoperative infection, randomised trials, renal failure, stroke rehabilitation, surgical wards, symptom scores, tumour staging, vaccine uptake",
    "physics": "cosmic rays, crystal defects, dark matter halos, electron mobility, gauge symmetry, gravitational lensing, laser cooling, magnetic fields, neutron scattering, optical cavities, particle detectors, phase transitions, photon counts, plasma turbulence, quantum states, shock waves, spin lattices, superconducting films, thermal conductivity, vacuum fluctuations",
    "software": "bug reports, build pipelines, cache invalidation, code reviews, compiler passes, container images, dependency graphs, garbage collectors, interface contracts, legacy modules, memory leaks, query planners, race conditions, refactoring tools, release branches, stack traces, static analysis, type checkers, unit tests, version histories",
    "law": "antitrust complaints, appellate courts, arbitration panels, asylum hearings, constitutional review, contract clauses, criminal sentencing, data protection duties, evidence rules, fiduciary duties, injunctive relief, judicial precedent, legislative intent, liability rules, patent disputes, plea agreements, property rights, statutory interpretation, tort damages, witness testimony",
    "linguistics": "case marking, child language, code switching, dialect surveys, discourse particles, idiom comprehension, lexical borrowing, loan words, negation scope, phoneme inventories, prosodic phrasing, relative clauses, second-language learners, sign languages, speech corpora, syntactic islands, tonal contrasts, verb morphology, vowel harmony, word order",
}
NOUNS = {
    "biology": "allele, canopy, chromosome, enzyme, habitat, larva, membrane, microbe, nectar, offspring, organism, phenotype, pollen, predator, ribosome, species, spore, tissue, genome, fauna, flora, protein",
    "machine_learning": "augmentation, backpropagation, benchmark, classifier, decoder, embedding, ensemble, epoch, logit, minibatch, optimiser, overfitting, perceptron, pretraining, regulariser, softmax, token, neural network, fine-tuning",
    "economics": "auctioneer, auction, bidder, broker, budget, buyer, cartel, commodity, export, inflation, lender, payoff, quota, rent, retailer, revenue, seller, shortage, subsidy, surplus, tariff, wage, welfare",
    "medicine": "anaesthesia, biopsy, catheter, clinician, comorbidity, diagnosis, dosage, follow-up, mortality, patient, prescription, prognosis, relapse, sepsis, surgeon, symptom, therapy, ward, hospital, disease",
    "physics": "boson, cryostat, detector, electron, entropy, interferometer, laser, lattice, magnetisation, momentum, neutrino, oscillation, photon, plasma, quark, spin, vacuum, wavelength, neutron, quantum",
    "software": "bug, commit, compiler, crash, debugger, deployment, interface, library, linker, module, parser, patch, pointer, refactoring, release, repository, scheduler, thread, source code",
    "law": "affidavit, appeal, clause, counsel, damages, defendant, injunction, judge, litigant, ordinance, plaintiff, precedent, remedy, statute, testimony, tort, tribunal, verdict, court, lawsuit",
    "linguistics": "consonant, corpus, dialect, gloss, inflection, intonation, loanword, morpheme, phoneme, pronoun, speaker, suffix, syllable, syntax, transcript, utterance, vowel, grammar",
}
OTHER_LANGUAGES = {
    "biology": "Blütenbesuche, Bodenbakterien, Enzymreaktionen, Genaktivität, Larvenstadien, Vogelzüge, Wurzelsysteme, Zellmembranen, bacterias del suelo, dispersión de semillas, expresión génica, larvas, membranas celulares, polinizadores, tasas de mutación, proteínas",
    "machine_learning": "Entscheidungswälder, Klassifikatoren, Lernraten, Merkmalsräume, neuronale Netze, Trainingsdaten, Verlustfunktionen, Vorhersagefehler, clasificadores, datos de entrenamiento, función de pérdida, redes neuronales, ruido de etiquetas, tasa de aprendizaje",
    "economics": "Auktionserlöse, Bieterabsprachen, Güternachfrage, Lohnverhandlungen, Marktmacht, Mindestpreise, Steuerlasten, Zinspolitik, ahorro familiar, aranceles, oferta laboral, política monetaria, precios de reserva, subastas selladas",
    "medicine": "Blutdruckwerte, Impfquoten, Krankenhausaufenthalte, Patientengruppen, Schmerzmittel, Therapieerfolge, Tumorstadien, Wundheilung, dolor crónico, ensayos clínicos, infecciones hospitalarias, presión arterial, tumores, vacunación",
    "physics": "Kristallfehler, Magnetfelder, Phasenübergänge, Photonenzahlen, Plasmawellen, Quantenzustände, Teilchendetektoren, Wärmeleitung, campos magnéticos, estados cuánticos, fotones, rayos cósmicos, transiciones de fase, turbulencia del plasma",
    "software": "Abhängigkeitsgraphen, Fehlerberichte, Modultests, Schnittstellenverträge, Speicherlecks, Typprüfungen, Versionsstände, Übersetzerläufe, código heredado, compiladores, dependencias, fugas de memoria, informes de errores, pruebas unitarias",
    "law": "Eigentumsrechte, Gerichtsurteile, Gesetzesauslegung, Haftungsregeln, Patentklagen, Strafmaße, Vertragsklauseln, Zeugenaussagen, cláusulas contractuales, jurisprudencia, patentes, responsabilidad civil, testigos, tribunales de apelación",
    "linguistics": "Dialekterhebungen, Kasusmarkierung, Lehnwörter, Nebensätze, Sprachkorpora, Verbformen, Vokalharmonie, Wortstellung, armonía vocálica, dialectos, morfología verbal, oraciones relativas, orden de palabras, préstamos léxicos",
}
#: General vocabulary of each subject, as textbooks and classifications of the sciences have it.
GENERAL = {
    "biology": "amino acid, amphibian, bacterium, biodiversity, biome, chloroplast, cytoplasm, ecosystem, embryo, eukaryote, fungus, gamete, heredity, mammal, meiosis, mitosis, natural selection, nucleotide, photosynthesis, phylogeny, symbiosis, taxonomy, vertebrate, zoology",
    "machine_learning": "autoencoder, bayesian network, clustering algorithm, convolutional network, cross-validation, decision tree, deep learning, feature selection, gaussian process, gradient boosting, hyperparameter, language model, learning rate, logistic regression, loss function, machine learning, random forest, recurrent network, reinforcement learning, self-supervised learning, supervised learning, support vector machine, test accuracy, training data",
    "economics": "capital market, central bank, comparative advantage, consumption, cost function, exchange rate, fiscal policy, gross domestic product, human capital, income inequality, interest rate, labour market, macroeconomics, marginal cost, market power, microeconomics, monopoly, opportunity cost, price elasticity, public good, recession, supply and demand, unemployment, utility function",
    "medicine": "anaemia, antibiotic, antibody, asthma, blood sample, cancer, cardiology, chemotherapy, clinical trial, diabetes, dialysis, epidemic, hypertension, immunisation, infection, intensive care, oncology, outpatient, pathology, pneumonia, radiology, stroke, surgery, vaccine",
    "physics": "angular momentum, atomic nucleus, black hole, electric charge, electromagnetism, fermion, general relativity, gravity, hadron, kinetic energy, magnetic field, particle accelerator, phase transition, photoelectric effect, quantum mechanics, radiation, semiconductor, spectroscopy, standard model, superconductivity, thermodynamics, ultraviolet, velocity, x-ray diffraction",
    "software": "agile development, api, application server, backend, continuous integration, data structure, database schema, design pattern, exception handling, framework, frontend, garbage collection, integrated development environment, kernel module, microservice, object-oriented programming, open source, operating system, programming language, pull request, regression test, software engineering, test suite, version control",
    "law": "administrative law, attorney, case law, civil procedure, common law, constitution, copyright, criminal law, due process, habeas corpus, human rights, indictment, international law, jurisdiction, jury, legislation, liability, litigation, negligence, plea bargain, prosecutor, subpoena, supreme court, treaty",
    "linguistics": "adjective, allophone, bilingualism, clitic, diphthong, discourse analysis, etymology, first language, fricative, generative grammar, language acquisition, lexicon, linguistics, morphology, orthography, phonetics, phonology, pragmatics, preposition, second language, semantics, sociolinguistics, subordinate clause, word formation",
}
GENERAL_OTHER = {
    "biology": "Artenvielfalt, Bakterien, Chromosomen, Evolution der Arten, Ökosystem, Zellteilung, Erbgut, biodiversidad, cromosomas, ecosistema, especies, fotosíntesis, hábitat, selección natural",
    "machine_learning": "maschinelles Lernen, überwachtes Lernen, tiefes Lernen, Lernverfahren, Gradientenabstieg, Überanpassung, aprendizaje automático, aprendizaje profundo, árboles de decisión, red neuronal, sobreajuste",
    "economics": "Arbeitsmarkt, Bruttoinlandsprodukt, Inflation, Nachfrage, Volkswirtschaft, Wettbewerbspolitik, Zentralbank, banco central, inflación, mercado laboral, oferta y demanda, producto interior bruto, salarios",
    "medicine": "Blutdruck, Diagnose, Impfung, Krankenhaus, Krankheit, Patienten, Therapie, Chirurgie, enfermedad, pacientes, hospital, diagnóstico, tratamiento médico, vacuna, cirugía",
    "physics": "Elektronen, Magnetfeld, Quantenmechanik, Relativitätstheorie, Teilchenphysik, Thermodynamik, Wellenlänge, campo magnético, electrones, mecánica cuántica, relatividad, termodinámica, longitud de onda",
    "software": "Betriebssystem, Datenbank, Programmiersprache, Quelltext, Softwareentwicklung, Versionsverwaltung, Fehlersuche, base de datos, código fuente, desarrollo de software, lenguaje de programación, sistema operativo",
    "law": "Gericht, Gesetzgebung, Klage, Rechtsprechung, Strafrecht, Verfassung, Vertragsrecht, Zivilrecht, constitución, derecho penal, legislación, tribunal, demanda judicial, sentencia judicial",
    "linguistics": "Grammatik, Sprachwissenschaft, Spracherwerb, Lautlehre, Mehrsprachigkeit, Wortbildung, Satzbau, adquisición del lenguaje, bilingüismo, fonología, gramática, lingüística, sintaxis",
}
#: Words that several subjects use in senses of their own, with those subjects. They support one
#: only next to certain sentences about it.
AMBIGUOUS = {
    "action": "law, machine_learning, physics", "agent": "economics, machine_learning, medicine, linguistics", "bond": "economics, physics, law",
    "case": "law, linguistics, medicine", "cell": "biology, medicine, physics", "cohort": "medicine, biology, economics",
    "commitment": "economics, law, software", "culture": "biology, linguistics, medicine", "equilibrium": "economics, physics, biology",
    "exposure": "medicine, physics, economics", "field": "physics, linguistics, software, biology", "inference": "machine_learning, linguistics, law",
    "network": "machine_learning, biology, software, physics", "policy": "economics, machine_learning, law", "response": "medicine, biology, physics",
    "standing": "law", "dataset": "machine_learning", "tree": "biology, machine_learning, linguistics, software",
}

_NOT_RUNNING = re.compile(
    r"^\s*(?:#+\s|\\|[-*•]\s|\[\d+\]\s|(?:keywords|key words|schlagwörter|stichwörter|palabras clave|index terms)\s*:|(?:table|figure|fig\.|tabelle|abbildung|tabla|figura)\s*\d+\s*[:.]|.*\|.*\|)",
    re.I,
)
#: How an entry of a reference list begins: a number or bullet, or names and a year.
_ENTRY = re.compile(r"^\s*(?:\[[^\]]{1,12}\]|\(?\d{1,3}[.)]|[-*•])\s|^\s*[^\W\d_][^\W\d_'’\-]+,? .{0,200}?\b(?:1[5-9]|20)\d\d[a-z]?\b")
_HEADING = re.compile(r"^\s*(?:#+\s|\\(?:sub)*section\b)")
_REFERENCES = re.compile(r"^\s*#*\s*(?:references|bibliography|literature|literatur|referencias|bibliografía)\s*:?\s*$", re.I)
_FORMULA = re.compile(r"\\begin\{(\w+\*?)\}.*?\\end\{\1\}", re.S)
_SENTENCE = re.compile(r"(?<=[.!?])[\"”’)\]*_]*\s+")
_INVISIBLE = re.compile("[\u00ad\u200b\u200c\u200d\ufeff]")
_MARKUP = re.compile(r"[*_]|\\(?:emph|textbf|textit)\{|<[^<>]{1,80}>")


def _terms() -> list[tuple[str, str, float]]:
    """(term, subject, weight); subject '' for ambiguous words."""
    out = []
    for table, weight, noun in ((PHRASES, PHRASE, False), (NOUNS, NOUN, True), (OTHER_LANGUAGES, PHRASE, False), (GENERAL, NOUN, True), (GENERAL_OTHER, NOUN, False)):
        for subject, terms in table.items():
            for t in terms.lower().split(", "):
                out += [(form, subject, weight) for form in sorted({t, *_plurals(t, noun)})]
    # a form that two tables have counts as the first has it
    out = list({form: (form, subject, weight) for form, subject, weight in reversed(out)}.values())[::-1]
    return out + [(form, "", 1.0) for t in AMBIGUOUS for form in {t, *_plurals(t, True)}]


@lru_cache(maxsize=1)
def _senses() -> dict[str, frozenset[str]]:
    return {form: frozenset(subjects.split(", ")) for t, subjects in AMBIGUOUS.items() for form in {t, *_plurals(t, True)}}


def _plurals(term: str, noun: bool) -> list[str]:
    spaced = [term.replace("-", " ")] if "-" in term else []
    if not noun:
        return spaced
    return [*spaced, term + "s", *([term[:-1] + "ies"] if term.endswith("y") else []), *([term + "es"] if term.endswith(("s", "x", "h")) else []), *([term + "e"] if term.endswith("a") else [])]


@lru_cache(maxsize=1)
def _lexicon():
    import ahocorasick

    a = ahocorasick.Automaton()
    terms = _terms()
    for no, (t, _, _) in enumerate(terms):
        a.add_word(t, (no, len(t)))
    a.make_automaton()
    return terms, a


def sentences(text: str) -> list[str]:
    """The sentences of the running text, with lines joined inside a paragraph.

    A reference list ends at a heading or at a paragraph that does not begin as an entry does.
    """
    text = _INVISIBLE.sub("", _FORMULA.sub("\n", text))
    out, open_ = [], []

    def close():
        if open_:
            out.extend(s for s in _SENTENCE.split(_MARKUP.sub("", re.sub(r"\s+", " ", " ".join(open_)))) if s.strip())
            open_.clear()

    listed, fresh = False, True
    for line in text.split("\n"):
        if _REFERENCES.match(line):
            close()
            listed, fresh = True, True
            continue
        if listed:
            if not line.strip():
                fresh = True
                continue
            # the lines of an entry go on until a blank line or the next entry
            if not _HEADING.match(line) and (not fresh or _ENTRY.match(line)):
                fresh = False
                continue
            listed = False
        if not line.strip() or _NOT_RUNNING.match(line):
            close()
        else:
            open_.append(line)
    close()
    return out


def match_terms(sentence: str) -> list[int]:
    """Numbers of the distinct lexicon terms in a sentence: whole words, the longest where they overlap."""
    _, automaton = _lexicon()
    s = sentence.lower()
    found = []
    for end, (no, n) in automaton.iter(s):
        a, b = end - n + 1, end + 1
        if (a == 0 or not (s[a - 1].isalnum() or s[a - 1] == "-")) and (b == len(s) or not (s[b].isalnum() or s[b] == "-")):
            found.append((a, b, no))
    found.sort(key=lambda x: (x[0], -x[1]))
    out, upto = [], -1
    for a, b, no in found:
        if a >= upto:
            out.append(no)
            upto = b
    return list(dict.fromkeys(out))


def support(hits: list[list[int]], rarity: list[float]) -> dict[str, tuple[float, float, float]]:
    """Per subject (support, certain support, share) from the term numbers of each sentence.

    A sentence gives a subject at most 1, and shares that out if it holds terms of several subjects.
    A sentence with ambiguous words alone gives half to those subjects of the nearest certain sentence
    on either side, at most two sentences away, in which its words have a sense.
    """
    terms, _ = _lexicon()
    per: list[dict[str, float]] = []
    loose: list[set[str]] = []
    senses = _senses()
    for h in hits:
        got: dict[str, float] = {}
        for no in h:
            _, subject, weight = terms[no]
            if subject:
                got[subject] = min(1.0, got.get(subject, 0.0) + weight * rarity[no])
        total = sum(got.values())
        per.append({k: v / max(1.0, total) for k, v in got.items()})
        loose.append(set() if got else {s for no in h if not terms[no][1] for s in senses.get(terms[no][0], ())})
    certain: dict[str, float] = {}
    for got in per:
        for k, v in got.items():
            certain[k] = certain.get(k, 0.0) + v
    total = dict(certain)
    for k, plausible in enumerate(loose):
        if not plausible:
            continue
        for step in (1, 2):
            near = {s for j in (k - step, k + step) if 0 <= j < len(per) for s in per[j]} & plausible
            if near:
                for s in near:
                    total[s] += 0.5 if len(near) == 1 else 0.3
                break
    everything = sum(total.values()) or 1.0
    return {s: (v, certain[s], v / everything) for s, v in total.items()}


def rarity_of(df: list[int], docs: int) -> list[float]:
    """1 for terms in at most a twentieth of the documents, falling with the logarithm to 0 for terms in all."""
    out = []
    for n in df:
        share = max(n, 1) / max(docs, 1)
        out.append(1.0 if share <= 0.05 or n < 20 else max(0.0, math.log(share) / math.log(0.05)))
    return out


def assign_subjects(
    docs: DataFrame, subjects: DataFrame, key: str = "doc_id", text: str = "text", least: float = SUPPORT, certain: float = CERTAIN, share: float = SHARE
) -> DataFrame:
    """(key, subject, support, share) for each subject that several sentences of a document are about.

    Only names in subjects.subject are returned; names that the lexicon lacks are never assigned.
    Null and empty texts and texts without any subject give no row. Repeated rows of a document
    repeat; texts of any length are read whole. A term's rarity is counted over all documents.
    Columns of other names are ignored. What goes to the driver is one count per lexicon term.
    """
    terms, _ = _lexicon()
    spark = docs.sparkSession
    d = distinct_names(docs, key, text)
    kind = dict(d.dtypes)[key]
    d = d.where(F.length(text) > 0).select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = [[match_terms(s) for s in sentences(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hits, pa.list_(pa.list_(pa.int32())))], names=["k", "hits"])

    matched = checkpoint(d.mapInArrow(match, "k string, hits array<array<int>>"))
    # one row per term of the lexicon, whatever the size of the corpus
    counts = {r["no"]: r["n"] for r in matched.select(F.explode(F.array_distinct(F.flatten("hits"))).alias("no")).groupBy("no").agg(F.count("*").alias("n")).collect()}
    rarity = rarity_of([counts.get(k, 0) for k in range(len(terms))], matched.count())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, hits in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows += [(k, s, a, p) for s, (a, c, p) in support(hits, rarity).items() if a >= least and c >= certain and p >= share]
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, (pa.string(), pa.string(), pa.float64(), pa.float64()))], names=["k", "subject", "support", "share"])

    found = matched.mapInArrow(score, "k string, subject string, support double, share double")
    known = distinct_names(subjects, "subject").where("subject is not null").distinct()
    out = found.join(known, "subject", "left_semi")
    return out.select(F.col("k").cast(kind).alias(key), "subject", "support", "share")
