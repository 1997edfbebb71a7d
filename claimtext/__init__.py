"""claimtext: text extraction and code retrieval as Spark jobs.

* ``claimtext.functions`` -- Column -> Column text functions (cleaning,
  folding, tokenising, stemming) and the lexicon / pattern builders.
* ``claimtext.operators`` -- DataFrame -> DataFrame operators: tuple
  extraction, vocabularies and the vocabulary filter, the code hierarchy,
  TF-IDF retrieval.
* ``claimtext.sources`` -- text files, tables and artefacts, HTML pages.
* ``claimtext.streaming`` -- the stateless operators on ``readStream``.
* ``claimtext.plans`` -- derived views and the registered query catalogue.
* ``claimtext.jobs`` -- one function / spark-submit target per processing step.
"""
