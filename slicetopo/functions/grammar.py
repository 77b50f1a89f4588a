"""Names of structures by grammars that are tables of parts.

A grammar lists its parts in the order in which they stand in a name; each has the words it can
be or a form, and what may stand around it without belonging to it. The tables are compiled
to one pattern, which is matched once a name: what its groups hold comes out as one text and is
split into columns. Lists of words also say in which order names are sorted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import to_millimetres

#: What stands between parts.
GAP = "[ _]*"
_CUT = "\u0001"


@dataclass(frozen=True)
class Part:
    """A part of a name: ``words`` or a ``form``; ``head``, ``tail``: what must stand around it;
    ``after``: what may follow it or its place. ``parts``: a part made of parts, of which one
    suffices if ``choice``."""

    name: str = ""
    words: tuple[str, ...] = ()
    form: str = ""
    head: str = ""
    tail: str = ""
    after: str = GAP
    needed: bool = False
    parts: tuple[Part, ...] = ()
    choice: bool = False

    @property
    def pattern(self) -> str:
        if self.parts:
            body = ("|" if self.choice else "").join(p.pattern for p in self.parts)
            body = f"(?:{body})" if self.choice else body
        else:
            body = "(" + "|".join([*([self.form] if self.form else []), *self.words]) + ")"
        body = self.head + body + self.tail
        return (body if self.needed else f"(?:{body})?") + self.after

    def names(self) -> list[str]:
        return [n for p in self.parts for n in p.names()] if self.parts else [self.name]


def pattern(grammar: tuple[Part, ...]) -> str:
    return "(?i)^" + "".join(p.pattern for p in grammar) + "$"


def names(grammar: tuple[Part, ...]) -> list[str]:
    return [n for p in grammar for n in p.names()]


def held(name: Column, grammar: tuple[Part, ...]) -> Column:
    """What a grammar's parts hold, as an array in their order, empty text for missing ones;
    null for other names. The pattern is matched once."""
    form = pattern(grammar)
    texts = F.regexp_replace(name, form, _CUT.join(f"${i + 1}" for i in range(len(names(grammar)))))
    return F.when(name.rlike(form), F.split(texts, _CUT, -1))


def parts_of(texts: Column, grammar: tuple[Part, ...]) -> Column:
    """Struct of what :func:`held` gave, null where parts are missing."""
    return F.when(texts.isNotNull(), F.struct(*[F.nullif(F.get(texts, i), F.lit("")).alias(n) for i, n in enumerate(names(grammar))]))


def _list(text: str) -> tuple[str, ...]:
    return tuple(w.strip() for w in text.strip().split("|"))


#: Words of targets, organs and other structures, in the order of lists.
TARGETS = _list("Nodes | Node | Iliac Vessels | Edema | Cavity | Operative Bed | GTV | IGTV | CTV | HTV | HRV | ITV | PTV")
REGIONS = _list(
    "Pyloric | Subpyloric | Gastric | Splenic | Celiac | Pancreatic | Hepatoduod | Hepatogastr | Hepatic | Para-Aortic | Obturator | Int iliac | ext iliac | "
    "com iliac | Sacral | Axilla 1 | Axilla 2 | Axilla 3 | Axilla III | Axilla II | Axilla I | IMC"
)
LEVELS, SIDES = _list("low | int | IR | PREOP | Cavity | RES | HR"), _list("L | LT | R | RT")
ORGANS = _list("""
Body | Normal Tissue | Skin | Bone | Bones | Skull | Brain | Temporal Lobes | Hippocampi | Hippo | Pituitary | Neural |
Neuro | OpticNerve | OpticChiasm | Optic Chiasm | Optics | Globe | Globes | Eyes | Lens | Lenses | Macula | Lacrimal |
LacrimalGland | BrainStem | Brain Stem | BR + op | Optics+BrStm | SpinalCord | SpinalCanal | Spinal Canal |
Spinal Cord | Cord | ThecalSac | Cauda Equina | Ear | Ear Middle | Ear Inner | Cochlea | Acoustic | Oral Cavity |
OralCavity | Oral | Mucosa | Mucosal | Tongue | Lip | Lips | Parotid | Submandibular | Mandible | Musc_Sclmast |
Carotid | Cricoid | Pharynx | PharynxConst | PharynxConstrict | Constrictors | Esophagus | Larynx | Trachea | Thymus |
Thyroid | BronchialTree | Bronchial Tree | Humorous | Humerus | Radius | Ulna | Hand | Digits | Clavicle |
BrachialPlex | Brachial_plexus | BrachialPlexs | BrachialPlexus | Plexus | brachiocephalic | AxillaryNerves |
Prox Bronch Zone | Prox Bronc  Zone | Prox Bronch Tree | ProxBronchZone | Axillary vessels | Breast | Chest Wall |
Scapula | subclavian Vein | Pectoralis minor | Pec major/minor | Heart | Aorta | Lung | Lungs | PulmonaryA |
Pulmonary Artery | PulmonaryArtery | Pulmonary Arter | SVC | Great Vessels | Celiac Artery | Celiac trunk | Celiac |
Ribs | Stomach | Spleen | Splenic Hilum | Duodenum | Jejunum | Liver | Portal Vein | Pancreas | PeritonealCavity |
MesentericA S | Sup Mesenteric A | Sup Mesnt Artery | Kidney | Kidneys | Renal hilum | Large Bowel | LargeBowel |
Colon | Small Bowel | SmallBowel | Bowel | Bowel Space | BowelBag | Bowel Bag | Femur | Tibia | Fibula | Pelvic Bones |
Hip | Bone Marrow | iliac crest | Ilium | Pubic Symphysis | Sacrum | Vessels | Sacral plexus | SacralPlexus |
Presacral space | FemoralHead | Femoral Head | Femur_Heads | Bladder | Bladder wall | Ureter | Urethra | groin |
Genitalia | Genitals | Ovary | Uterus | Cervix | Vagina | Vagina Empty | Vagina Full | Prostate | Seminal Ves |
Penile  bulb | Sigmoid | Rectosigmoid | Rectum | MesoRectum | Anorectosigmoid | Ano-Rectum | Anus | Anal Canal
""")
OTHERS = {
    "Avoidance": _list("Avoidance | Avoid | Ring"),
    "Couch": _list("Surface | Interior | RailLeft | RailRight"),
    "Bolus": _list("Bolus | Bol | Gauze | Barts | Pink"),
    "Foreign": _list("CIED | prosthesis | implant | expander | screws | staples | hardware | Metal | Dental | anastomosis | stoma"),
    "Marker": _list("BBs | BB | fiducial | fiducials | MARKER | OVOID | Wires | Wire | Match | Baseline"),
    "Density": _list("Air | Contrast"),
    "Field": _list("Field | Beam | edge | guide"),
}
DOSES = _list("EVAL50 | PREV | old | Dose | D | BOB")

#: A number, and a size with its unit.
_NUMBER, _UNIT = "[0-9.]+", "[cm]m"
TARGET = (
    Part("Mod", words=("eval", "opt", "mod")),
    Part("TargetType", words=TARGETS, needed=True, after=""),
    Part("TargetSuffix", words=("n", "p", "m"), tail="(?![A-Za-z]{2})"),
    Part("TargetNumber", form="[1-9]|1[0-5]", head="(?<![0-9.+-])", tail="(?![0-9.Dcm])"),
    Part("Metabolic", words=("T1", "T2", "MRI", "PET", "CT")),
    Part("Motion", form="4D[0-9][0-9]?", words=("MIP", "AIP", "AVE")),
    Part("Region", words=REGIONS),
    Part("Level", words=LEVELS, tail="(?![D-Zd-z]{2})"),
    Part("TargetDose", form="[0-9.]{2,}", head="[- _]*", tail="(?:[ cGy]{2,3})?(?:/[0-9]+#?)?"),
    Part("Combined", words=("Total", "All"), head="[- ]*"),
    Part("TargetOrgan", form="[A-Za-z]{3,}"),
    Part(
        parts=(
            Part(parts=(Part("ExpansionSize1", form=_NUMBER, needed=True, after=""), Part("ExpansionUnit1", form=_UNIT, needed=True, after="")), needed=True, after=""),
            Part(parts=(Part("ExpansionSign", form="[+-]", needed=True, after=""), Part("ExpansionSize2", form=_NUMBER, needed=True, after=""), Part("ExpansionUnit2", form=_UNIT, after="")), needed=True, after=""),
        ),
        choice=True,
    ),
    Part(parts=(Part("SubtractionSign", form="-", needed=True, after=" *"), Part("OrganSubtraction", form="[A-Za-z]*", needed=True, after=""))),
    Part("TargetLaterality", words=SIDES),
    Part("SubGroup", form="[abc]", after=""),
    Part("Remainder", form=".+", after=""),
)
ORGAN = (
    Part("Opt", words=("opt",), after=" *"),
    Part(parts=(Part("PRV_Text", words=("PRV",), needed=True, after=" *"), Part("PRV_Size", form="[0-9.]*", needed=True, after=" *"), Part("PRV_Unit", form="[cm]*", needed=True, after="")), after=" *"),
    Part("BaseOAR", words=ORGANS, needed=True),
    Part("OAR_Laterality", words=(*SIDES, "B")),
    Part(
        parts=(
            Part("TargetCrop", words=TARGETS[6:], head="- *", needed=True),
            Part(parts=(Part("TargetModText", form="[A-Za-z_]+", after=" *"), Part("TargetModSign", form="[+-] *", after=""), Part("TargetModNum", form=_NUMBER, after=""), Part("TargetModRes", form=".*", after="")), after=""),
        ),
        after="",
    ),
    Part("OtherCrop", words=("Board", "Bolus"), head="- *"),
    Part(parts=(Part("ExpansionSize", form=_NUMBER, after=""), Part("ExpansionUnit", form="[cm]{2}", after=""), Part("ExpansionText", form="[A-Za-z_]+", after="")), head="[+] *"),
    Part("Occurrence", form="[0-9]+", after=""),
)


def other(kind: str) -> tuple[Part, ...]:
    """The grammar of one kind of other structures: a word, and what stands before and after it."""
    if kind == "Dose":
        return (Part("DoseType", words=DOSES, head=".*?", needed=True, after=" *"), Part("DoseValue", form=_NUMBER, needed=True, after=r"[ \[]*"), Part("DoseUnits", form="[%cGy]*", needed=True, after=r"[ \]]*"), Part("DoseSuffix", form=".*", needed=True, after=""))
    words = tuple(f"(?:{w})s?" for w in OTHERS[kind]) if kind == "Marker" else OTHERS[kind]
    return (Part(f"{kind}Prefix", form=".*?", needed=True), Part(f"{kind}Type", words=words, needed=True), Part(f"{kind}Suffix", form=".*", needed=True, after=""))


KINDS = (*OTHERS, "Dose")


def _place(value: Column, words: tuple[str, ...]) -> Column:
    """Place of a word in a list in any case, from 1; words outside it come after, missing ones
    before."""
    at = F.array_position(F.array(*[F.lit(w.lower()) for w in words]), F.lower(value))
    return F.when(value.isNull(), 0).when(at > 0, at).otherwise(len(words) + 1).cast("int")


def side(value: Column) -> Column:
    """L and R for their long forms too."""
    return F.when(F.lower(value).isin("l", "lt"), "L").when(F.lower(value).isin("r", "rt"), "R").otherwise(value)


def components(rows: DataFrame, name: str = "name") -> DataFrame:
    """``rows`` with what a name says: its kind (target, organ, that of another structure, or
    null for what no grammar takes), its parts by the first grammar that takes it, and what
    follows from them: the dose in cGy, the level, the expansion in mm, and the side. Later
    grammars are matched only where no earlier one takes the name."""
    n = F.col(name)
    out = rows.withColumn("_t", held(n, TARGET))
    out = out.withColumn("_o", F.when(F.col("_t").isNull(), held(n, ORGAN)))
    kind = F.when(F.col("_t").isNotNull(), "target").when(F.col("_o").isNotNull(), "organ")
    for k in KINDS:
        kind = kind.when(n.rlike(pattern(other(k))), k)
    out = out.withColumn("kind", kind)
    word = F.lit(None).cast("string")
    for k in KINDS:
        at = names(other(k)).index(f"{k}Type")
        word = F.when(F.col("kind") == k, F.get(held(n, other(k)), at)).otherwise(word)
    out = out.withColumns({"target": parts_of(F.col("_t"), TARGET), "organ": parts_of(F.col("_o"), ORGAN), "other_type": word}).drop("_t", "_o")
    t, o = F.col("target"), F.col("organ")
    dose = t["TargetDose"].try_cast("double")
    size, unit = F.coalesce(t["ExpansionSize1"], t["ExpansionSize2"]).try_cast("double"), F.coalesce(t["ExpansionUnit1"], t["ExpansionUnit2"], F.lit(""))
    return out.withColumns({
        "cgy": F.when(dose > 100, dose).otherwise(dose * 100), "level": F.coalesce(t["Level"], t["TargetSuffix"]),
        "expansion_sign": F.coalesce(F.trim(t["ExpansionSign"]), t["SubtractionSign"]), "expansion_mm": to_millimetres(size, unit),
        "side": F.coalesce(side(t["TargetLaterality"]), side(o["OAR_Laterality"])),
    })


def order() -> Column:
    """Struct by which rows of :func:`components` are listed: targets by kind, side, dose, level
    and number, then organs in the order of their list and by side, then other structures by
    kind and word, then the rest."""
    kind, t, o = F.col("kind"), F.col("target"), F.col("organ")
    group = F.when(kind == "target", 0).when(kind == "organ", 1).when(kind.isNotNull(), 2).otherwise(3)
    word = F.lit(0)
    for k in KINDS:
        word = F.when(kind == k, _place(F.col("other_type"), OTHERS.get(k, DOSES))).otherwise(word)
    first = F.when(group == 0, _place(t["TargetType"], TARGETS)).when(group == 1, _place(o["BaseOAR"], ORGANS)).otherwise(_place(kind, KINDS))
    second = F.when(group == 2, word).otherwise(_place(F.col("side"), ("L", "R", "B")))
    level = F.when(group == 0, _place(F.col("level"), (*LEVELS, "n", "p", "m"))).otherwise(0)
    number = F.coalesce(t["TargetNumber"].try_cast("int"), o["Occurrence"].try_cast("int"), F.lit(0))
    return F.struct(group.alias("group"), first.alias("first"), second.alias("second"), F.coalesce("cgy", F.lit(0.0)).alias("dose"), level.alias("level"), number.alias("number"))
