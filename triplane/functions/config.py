"""Domain rules as plain data; every function that uses them takes them as a parameter."""

# URIs of RDF.
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS_LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
SKOS_DEFINITION = "http://www.w3.org/2004/02/skos/core#definition"

# Prefixes, tried in this order.
PREFIXES = (
    ("https://www.imgt.org/imgt-ontology#", "imgt:"),
    ("http://www.imgt.org/imgt-ontology#", "imgt:"),
    ("http://purl.obolibrary.org/obo/", "obo:"),
    ("https://purl.obolibrary.org/obo/", "obo:"),
    ("http://www.genenames.org/data/gene-symbol-report/#!/hgnc_id/", "HGNC:"),
    ("https://www.genenames.org/data/gene-symbol-report/#!/hgnc_id/", "HGNC:"),
    ("http://www.orpha.net/ORDO/", "ORDO:"),
    ("https://www.orpha.net/ORDO/", "ORDO:"),
    ("http://identifiers.org/drugbank/", "drugbank:"),
    ("https://identifiers.org/drugbank/", "drugbank:"),
    ("http://identifiers.org/uniprot/", "uniprot:"),
    ("https://identifiers.org/uniprot/", "uniprot:"),
)

# Families by the beginning of the local name, in this order.
FAMILY_PREFIXES = ("mAb", "StudyProduct", "Product", "Decision", "Construct", "Segment", "Clone", "MOA", "Phase")
ONTOLOGY_PREFIXES = ("obo:MONDO_", "doid:", "ORDO:")
DISEASE_PREFIXES = ("Cancers_", "Cancer_", "Carcinoma_", "Lymphoma_", "Leukemia_", "Melanoma_", "Myeloma_", "Solid_tumors")
AGENCIES = ("FDA", "EMA")
COMPANY_SUFFIXES = ("_Inc", "_Ltd", "_GmbH", "_Corp", "_Corporation", "_PLC", "_SA", "_SAS", "_LLC")
LABELLED_PREFIXES = ("ncit:", "imgt:", "obo:", "ORDO:")

# Categories that an entity can have by name.
GENERIC_CATEGORIES = (
    "mAb", "INN", "StudyProduct", "Product", "Decision", "Construct", "Segment", "Clone", "MOA", "Disease", "Organisation",
    "Phase", "NumericId", "Conjugate", "Fused", "ExpressionSystem", "ConstructLabels", "SegmentLabels", "ChainLabels",
    "ReceptorType", "ReceptorFormat",
)

# Types that are no category.
NO_CATEGORY = ("Class", "NamedIndividual")

# Parts of words that name a disease.
DISEASE_HINTS = (
    "cancer", "carcinoma", "lymphoma", "leukemia", "leukaemia", "myeloma", "melanoma", "tumor", "tumour", "sarcoma", "disease",
    "syndrome", "arthritis", "psoriasis", "sclerosis", "colitis", "hepatitis", "asthma", "fibrosis", "amyloidosis",
    "hemophilia", "enteropathy",
)

# Family, strategy, prior, alignment.
GUIDANCE = (
    ("mAb", "protein_sequence", "ESM or other antibody/protein LM on the amino-acid sequence", "project sequence embeddings into KG space with a learned linear layer or small MLP"),
    ("Construct", "composition", "compose from ordered Segment members and construct labels", "encode segment order plus segment priors; use set/sequence pooling before KG projection"),
    ("Segment", "structured_text", "embed IMGT segment labels, linker labels, payload labels, and chain labels as text", "text encoder or ontology-label encoder projected into KG space"),
    ("Product", "graph_composition", "compose from linked mAb, StudyProduct, company, construct, and conjugate metadata", "aggregate neighboring typed priors with a relation-aware encoder"),
    ("StudyProduct", "clinical_text", "compose from disease indication, phase, sponsor, designation, and mechanism nodes", "clinical metadata encoder projected into KG space"),
    ("Decision", "regulatory_metadata", "encode agency, status, designation, and linked study-product context", "tabular/text metadata encoder into KG space"),
    ("HGNC", "gene_text_or_sequence", "gene/protein embeddings from gene symbol, protein sequence, or biomedical text", "map gene-side priors separately from antibody-side priors before fusion"),
    ("MOA", "mechanism_text", "sentence embeddings over mechanism-of-action labels and linked references", "text encoder with ontology-aware projection"),
    ("Clone", "identifier_only", "usually weak without external metadata; fall back to learned KG embedding unless clone attributes exist", "optionally tie clone and parent mAb embeddings with regularization"),
    ("Disease", "biomedical_text_or_ontology", "disease ontology embeddings from MONDO/DOID/ORDO labels, definitions, and graph structure", "separate ontology encoder aligned into KG space"),
    ("Organisation", "name_text", "organization name embeddings or learned embeddings if names are sparse", "small projection or plain learned KG vectors"),
    ("Phase", "categorical", "small learned categorical embeddings", "no heavy prior needed"),
    ("NumericId", "categorical", "treat as identifier nodes unless linked metadata is available", "plain learned embeddings are usually sufficient"),
)
# The same for all others.
DEFAULT_GUIDANCE = ("text_or_learned", "use label/definition text if available; otherwise learn the embedding in the KG model", "single projection into the KG latent space")

# The pattern of a URI, names of relations, and patterns of a family's members and the links of their sequences.
URI = "^[a-zA-Z][a-zA-Z0-9+.-]*://"
INDICATION_RELATIONS = ("imgt:hasClinicalIndication", "imgt:isClinicalIndicationOf")
MEMBER, LINK_RELATION, LINK_TARGET = "^imgt:mAb_(\\d+)$", "imgt:isLinkedToStructureAccessNumb", "^imgt:(\\d+)$"
