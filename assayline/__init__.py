"""assayline: acceptance audits of large text corpora as Spark jobs."""

from assayline.plans.audits import AUDITS
from assayline.session import build_session, scratch_root, settle
from assayline.spec import CORPUS, CorpusMap

__all__ = ["AUDITS", "CORPUS", "CorpusMap", "build_session", "scratch_root", "settle"]
