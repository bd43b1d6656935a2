"""License scans: ordered signature rules behind a keyword prefilter; priority and containment settle overlaps."""

from __future__ import annotations

import bisect
import functools
import itertools
import re
from re import _constants, _parser

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship, slices, table, text_buffer, with_fields
from .words import LOWER, spans

#: Word bytes of lower-cased text: all but \x00-\x2F, \x3A-\x60 and \x7B-\x7F.
WORD = np.ones(256, bool)
WORD[0x00:0x30] = WORD[0x3A:0x61] = WORD[0x7B:0x80] = False
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Rules: one line for a family, "label | confidence | regex | regex ...". A regex is tried only where all literals that
# any match of it contains stand in the lower-cased text. Earlier lines have priority. "_" is any run of white space and
# punctuation.
RULES = r"""
agpl-3.0 | .98 | gnu_affero_general_public_licen[sc]e_v(?:ersion_)?3 | gnu_affero_general_public_licen[sc]e,?_version_3 | affero_gpl_?v?3
agpl-1.0 | .9 | affero_general_public_licen[sc]e_version_1 | affero_general_public_licen[sc]e,?_v(?:ersion)?_?1
agpl | .85 | gnu_affero_general_public_licen[sc]e | affero_general_public_licen[sc]e | affero_gpl
agpl-3.0-spdx | .95 | agpl-3\.0(?:-only|-or-later)? | agplv3\+? | agpl_v3
agpl-short | .7 | licensed_under_(?:the_)?agpl | under_the_agpl
lgpl-2.1 | .98 | gnu_lesser_general_public_licen[sc]e,?_v(?:ersion)?_?2\.1 | lesser_gpl_?v?2\.1
lgpl-3.0 | .98 | gnu_lesser_general_public_licen[sc]e,?_v(?:ersion)?_?3 | lesser_gpl_?v?3
lgpl | .85 | gnu_lesser_general_public_licen[sc]e | lesser_general_public_licen[sc]e | lesser_gpl
lgpl-2.0 | .95 | gnu_library_general_public_licen[sc]e | library_general_public_licen[sc]e,?_version_2
lgpl-spdx | .95 | lgpl-(?:2\.0|2\.1|3\.0)(?:-only|-or-later)? | lgplv(?:2|2\.1|3)\+? | lgpl_v?(?:2\.1|3)
lgpl-short | .7 | licensed_under_(?:the_)?lgpl | under_the_(?:terms_of_the_)?lgpl
gpl-3.0-or-later | .98 | gnu_general_public_licen[sc]e.{0,120}?version_3.{0,60}?any_later_version | gpl_?v?3_or_later
gpl-2.0-or-later | .98 | gnu_general_public_licen[sc]e.{0,120}?version_2.{0,60}?any_later_version | gpl_?v?2_or_later
gpl-3.0 | .97 | gnu_general_public_licen[sc]e,?_v(?:ersion)?_?3 | general_public_licen[sc]e_\(?v3
gpl-2.0 | .97 | gnu_general_public_licen[sc]e,?_v(?:ersion)?_?2 | general_public_licen[sc]e_\(?v2
gpl-1.0 | .9 | gnu_general_public_licen[sc]e,?_v(?:ersion)?_?1
gpl-notice | .85 | gnu_general_public_licen[sc]e | the_general_public_licen[sc]e_as_published_by_the_free_software_foundation
gpl-spdx | .95 | gpl-(?:1\.0|2\.0|3\.0)(?:-only|-or-later)? | gpl-(?:2|3)\+?
gpl-v | .95 | gplv(?:1|2|3)\+? | gnu_gplv(?:1|2|3)
gpl-short | .7 | gnu_gpl | licensed_under_(?:the_)?gpl | (?:released|distributed)_under_(?:the_)?gpl | under_the_terms_of_the_gpl
gfdl-1.3 | .95 | gnu_free_documentation_licen[sc]e,?_version_1\.3
gfdl | .85 | gnu_free_documentation_licen[sc]e | free_documentation_licen[sc]e,?_version_1\.[12]
gfdl-spdx | .9 | gfdl-1\.[123](?:-only|-or-later|-invariants-only)? | licensed_under_(?:the_)?gfdl
apache-2.0 | .98 | apache_licen[sc]e,?_version_2\.0 | apache_licen[sc]e_?v?2(?:\.0)? | apache-2\.0 | apache_2\.0_licen[sc]e | apache\.org/licenses/license-2\.0
apache-1.1 | .95 | apache_software_licen[sc]e,?_version_1\.1 | apache-1\.1
apache-1.0 | .95 | apache_software_licen[sc]e,?_version_1\.0 | apache-1\.0
apache | .75 | licensed_under_(?:the_)?apache_licen[sc]e | apache_software_licen[sc]e | apache_software_foundation_\(asf\)_under
mit-0 | .9 | mit-0 | mit_no_attribution
mit | .95 | (?:released|licensed|distributed|available)_under_the_mit_licen[sc]e | the_mit_licen[sc]e_\(mit\) | mit_licen[sc]e
mit-short | .7 | licen[sc]e:_mit\b | licensed_under_mit\b | spdx-license-identifier:_mit\b
mit-text | .95 | permission_is_hereby_granted,?_free_of_charge,?_to_any_person_obtaining_a_copy | free_of_charge,?_to_any_person_obtaining_a_copy_of_this_software
mit-text-sublicense | .85 | use,?_copy,?_modify,?_merge,?_publish,?_distribute,?_sublicense
bsd-4-clause | .95 | all_advertising_materials_mentioning_features_or_use_of_this_software | bsd-4-clause
bsd-3-clause | .95 | bsd-3-clause(?:-clear)? | (?:3|three)-?_?clause_bsd | new_bsd_licen[sc]e | modified_bsd_licen[sc]e | bsd_3-clause | revised_bsd_licen[sc]e
bsd-2-clause | .95 | bsd-2-clause(?:-patent|-views)? | (?:2|two)-?_?clause_bsd | simplified_bsd_licen[sc]e | freebsd_licen[sc]e | bsd_2-clause
0bsd | .9 | 0bsd | zero_clause_bsd | bsd_zero_clause
bsd | .75 | bsd_licen[sc]e | bsd-style_licen[sc]e | licensed_under_(?:the_)?bsd | berkeley_software_distribution_licen[sc]e
bsd-text | .9 | redistribution_and_use_in_source_and_binary_forms | redistributions_of_source_code_must_retain
bsd-text-endorse | .85 | may_be_used_to_endorse_or_promote_products_derived
isc | .9 | isc_licen[sc]e | licensed_under_(?:the_)?isc
isc-text | .85 | permission_to_use,?_copy,?_modify,?_and(?:/or)?_distribute_this_software_for_any_purpose
mpl-2.0 | .97 | mozilla_public_licen[sc]e,?_v(?:ersion)?\.?_?2\.0 | mozilla\.org/mpl/2\.0
mpl-1.1 | .95 | mozilla_public_licen[sc]e,?_v(?:ersion)?\.?_?1\.1 | mozilla\.org/mpl/mpl-1\.1
mpl | .8 | mozilla_public_licen[sc]e
mpl-spdx | .9 | mpl-(?:1\.0|1\.1|2\.0)(?:-no-copyleft-exception)?
epl-2.0 | .95 | eclipse_public_licen[sc]e,?_-?_?v(?:ersion)?_?2\.0 | epl-2\.0
epl-1.0 | .95 | eclipse_public_licen[sc]e,?_-?_?v(?:ersion)?_?1\.0 | epl-1\.0
epl | .8 | eclipse_public_licen[sc]e | eclipse_distribution_licen[sc]e
cddl-1.0 | .9 | cddl-1\.[01] | cddl_?v?1\.[01] | under_the_cddl
cddl | .9 | common_development_and_distribution_licen[sc]e
cpl-1.0 | .9 | common_public_licen[sc]e,?_version_1\.0 | common_public_licen[sc]e
ipl-1.0 | .9 | ibm_public_licen[sc]e
eupl-1.2 | .95 | european_union_public_licen[sc]e,?_v(?:ersion)?\.?_?1\.2 | european_union_public_licen[sc]e
eupl | .9 | eupl-1\.[012] | eupl_v?\.?1\.[012] | licensed_under_the_eupl
cecill | .9 | cecill-(?:1\.[01]|2\.[01]|b|c) | cecill_free_software_licen[sc]e | licence_cecill
artistic-2.0 | .95 | artistic_licen[sc]e,?_(?:version_)?2\.0 | artistic-2\.0
artistic-1.0 | .85 | artistic_licen[sc]e,?_(?:version_)?1\.0 | artistic-1\.0(?:-perl|-cl8)? | perl_artistic_licen[sc]e | the_artistic_licen[sc]e
perl | .85 | under_the_same_terms_as_perl_itself
python-2.0 | .9 | python_software_foundation_licen[sc]e(?:_version_2)? | psf-2\.0 | psf_licen[sc]e_agreement | python-2\.0
zlib | .85 | zlib_licen[sc]e | zlib/libpng_licen[sc]e | zlib-acknowledgement
zlib-text | .85 | this_software_is_provided_'as-is',?_without_any_express_or_implied_warranty
libpng | .8 | libpng_licen[sc]e | libpng-2\.0
boost-1.0 | .95 | boost_software_licen[sc]e(?:,?_-?_?version_1\.0)? | bsl-1\.0_boost
unlicense | .9 | the_unlicense | unlicense\.org | licensed_under_(?:the_)?unlicense
unlicense-text | .9 | free_and_unencumbered_software_released_into_the_public_domain
public-domain | .75 | (?:released|placed|dedicated)_(?:in|into|to)_the_public_domain | public_domain_dedication | in_the_public_domain
wtfpl | .85 | wtfpl | do_what_the_fuck_you_want_to_public_licen[sc]e
beerware | .8 | the_beer-?ware_licen[sc]e | beerware
openssl | .9 | openssl_licen[sc]e | openssl_toolkit | openssl_and_ssleay_licen[sc]es?
ssleay | .85 | original_ssleay_licen[sc]e | eric_young_\(eay@cryptsoft
curl | .7 | curl_licen[sc]e | licensed_under_the_curl
postgresql | .85 | postgresql_licen[sc]e
php-3.01 | .9 | php_licen[sc]e,?_v(?:ersion)?_?3\.01? | php-3\.01?
ruby | .8 | ruby_licen[sc]e | under_the_same_terms_as_ruby
vim | .8 | vim_licen[sc]e
x11 | .85 | x11_licen[sc]e | mit/x11 | x_consortium_licen[sc]e
w3c | .9 | w3c_software_(?:notice_and_)?licen[sc]e | w3c_document_licen[sc]e
ms-pl | .9 | microsoft_public_licen[sc]e | ms-pl
ms-rl | .9 | microsoft_reciprocal_licen[sc]e | ms-rl
msft-eula | .7 | microsoft_software_licen[sc]e_terms | microsoft_end_user_licen[sc]e
apsl | .9 | apple_public_source_licen[sc]e(?:,?_version_[12]\.\d)?
npl | .85 | netscape_public_licen[sc]e
spl | .85 | sun_public_licen[sc]e | sun_industry_standards_source_licen[sc]e
osl-3.0 | .9 | open_software_licen[sc]e_(?:version_)?3\.0 | open_software_licen[sc]e
afl-3.0 | .9 | academic_free_licen[sc]e(?:,?_(?:version_|v\.?)?[123]\.\d)?
ecl-2.0 | .9 | educational_community_licen[sc]e(?:,?_version_2\.0)?
ncsa | .9 | university_of_illinois/ncsa_open_source_licen[sc]e | university_of_illinois.{0,20}open_source_licen[sc]e
upl-1.0 | .9 | universal_permissive_licen[sc]e
ofl-1.1 | .95 | sil_open_font_licen[sc]e(?:,?_version_1\.1)? | open_font_licen[sc]e
ofl-spdx | .85 | ofl-1\.[01] | scripts\.sil\.org/ofl
odbl-1.0 | .95 | open_database_licen[sc]e | odbl
odc-by | .9 | open_data_commons_attribution_licen[sc]e | open_data_commons_public_domain
pddl | .85 | pddl-1\.0 | odc_pddl
ogl | .9 | open_government_licen[sc]e(?:_v?[123]\.0)? | uk_ogl
etalab | .85 | licence_ouverte | etalab-2\.0
dl-de | .85 | datenlizenz_deutschland | dl-de/by-2-0
cdla | .9 | community_data_licen[sc]e_agreement | cdla-(?:permissive|sharing)-[12]\.0
bsl-1.1 | .9 | business_source_licen[sc]e(?:_1\.1)? | busl-1\.1
sspl-1.0 | .95 | server_side_public_licen[sc]e | sspl
elastic-2.0 | .9 | elastic_licen[sc]e(?:_2\.0|_v2)?
commons-clause | .9 | commons_clause(?:_licen[sc]e_condition)?
polyform | .9 | polyform_(?:noncommercial|shield|perimeter|strict|small_business|free_trial|internal_use)_licen[sc]e
redis | .8 | redis_source_available_licen[sc]e
hippocratic | .9 | hippocratic_licen[sc]e
openrail | .85 | openrail(?:-m|\+\+)? | responsible_ai_licen[sc]e | creativeml_open_rail
llama | .85 | llama_?[234]?(?:\.\d)?_community_licen[sc]e
blueoak | .9 | blue_oak_model_licen[sc]e
mulan | .9 | mulan_permissive_software_licen[sc]e | mulanpsl-2\.0
cc-by-nc-nd-4.0 | .97 | cc_by-nc-nd_4\.0 | cc_by-nc-nd(?:_[123]\.\d)?
cc-by-nc-sa-4.0 | .97 | cc_by-nc-sa_4\.0 | cc_by-nc-sa(?:_[123]\.\d)?
cc-by-nc-4.0 | .97 | cc_by-nc_4\.0
cc-by-nc | .9 | cc_by-nc(?:_[123]\.\d)?
cc-by-nd-4.0 | .95 | cc_by-nd_4\.0 | cc_by-nd(?:_[123]\.\d)?
cc-by-sa-4.0 | .97 | cc_by-sa_4\.0
cc-by-sa | .9 | cc_by-sa(?:_[123]\.\d)?
cc-by-4.0 | .95 | cc_by_4\.0
cc-by-old | .9 | cc_by_[123]\.\d
cc-by-hyphen | .9 | cc-by-(?:nc|sa|nd|nc-sa|nc-nd)(?:-[1-4]\.\d)? | cc-by(?:-[1-4]\.\d)?
cc0-1.0 | .95 | cc0(?:_|-)1\.0(?:_universal)? | cc0_public_domain | cc0
cc-zero | .95 | creative_commons_zero(?:_v?1\.0_universal)? | creative_commons_public_domain
cc-by-nc-sa-text | .97 | creative_commons_attribution-?_?non-?commercial-?_?share-?_?alike(?:_[1-4]\.\d)?
cc-by-nc-nd-text | .97 | creative_commons_attribution-?_?non-?commercial-?_?no-?_?deriv(?:ative)?s?(?:_[1-4]\.\d)?
cc-by-nc-text | .95 | creative_commons_attribution-?_?non-?commercial(?:_[1-4]\.\d)?
cc-by-sa-text | .95 | creative_commons_attribution-?_?share-?_?alike(?:_[1-4]\.\d)?
cc-by-nd-text | .95 | creative_commons_attribution-?_?no-?_?deriv(?:ative)?s?(?:_[1-4]\.\d)?
cc-by-text | .9 | creative_commons_attribution(?:_[1-4]\.\d)?(?:_international|_unported)?(?:_licen[sc]e)?
cc | .7 | creative_commons_licen[sc]e | licensed_under_(?:a_)?creative_commons
cc-url | .95 | creativecommons\.org/licenses/by(?:-nc|-sa|-nd)*/[1-4]\.\d | creativecommons\.org/publicdomain/(?:zero|mark)/1\.0
all-rights-reserved | .8 | all_rights_reserved | tous_droits_réservés | alle_rechte_vorbehalten | todos_los_derechos_reservados
droits | .8 | tous_droits_réservés | tous_droits_de_reproduction_réservés
rechte | .8 | alle_rechte_vorbehalten
derechos | .8 | todos_los_derechos_reservados | reservados_todos_los_derechos
some-rights-reserved | .7 | some_rights_reserved | no_rights_reserved
copyright | .55 | copyright_(?:\(c\)_|©_?)?(?:19|20)\d\d(?:_?[-–]_?(?:19|20)?\d\d)? | copyright_(?:\(c\)|©) | copyright_holders?
copyright-sign | .5 | ©_?(?:19|20)\d\d
proprietary | .7 | proprietary_and_confidential | proprietary_licen[sc]e | proprietary_software
confidential | .5 | strictly_confidential | confidential_and_proprietary | confidential_information
eula | .75 | end_user_licen[sc]e_agreement | end-user_licen[sc]e_agreement
trademark | .4 | (?:registered_)?trademarks?_of_their_respective_owners | registered_trademark_of
no-redistribution | .6 | may_not_be_redistributed | redistribution_is_prohibited | not_for_redistribution
permission | .6 | without_(?:prior_|express_|specific_)*written_permission
noncommercial | .6 | for_non-?commercial_use_only | non-?commercial_use_only | not_for_commercial_use | commercial_use_is_prohibited
evaluation | .5 | for_evaluation_purposes_only | evaluation_licen[sc]e
warranty | .45 | without_warranty_of_any_kind | without_any_warranty | disclaims_all_warranties
merchantability | .45 | implied_warrant(?:y|ies)_of_merchantability
as-is | .4 | provided_"as_is" | provided_as_is | on_an_"as_is"_basis
spdx | .9 | spdx-license-identifier:_[a-z0-9.+()-]+ | spdx\.org/licenses/[a-z0-9.+-]+
dual | .6 | dual-?_?licensed_under | dual_licen[sc]e
see-license | .45 | see_(?:the_)?licen[sc]e(?:\.md|\.txt|_file)? | licen[sc]e_file | full_licen[sc]e_text
licensed-under | .5 | licensed_under_(?:the_)?[a-z0-9.-]+ | licensed_under_the_terms_of
released-under | .45 | released_under_(?:the_)?[a-z0-9.-]+_licen[sc]e | released_under_a
distributed-under | .45 | distributed_under_(?:the_)?(?:terms_of_(?:the_)?)?[a-z0-9.-]+_licen[sc]e
license-url | .8 | opensource\.org/licenses/[a-z0-9.-]+
gnu-url | .8 | gnu\.org/licenses/[a-z0-9.-]+ | gnu\.org/copyleft/[a-z0-9.-]+
open-source | .4 | open_source_licen[sc]e | open-source_licen[sc]e | osi-?_?approved
copyleft | .5 | copyleft_licen[sc]e | copyleft
royalty-free | .5 | royalty-?_?free,?_(?:worldwide|perpetual|non-?exclusive) | royalty-?free_licen[sc]e
patent-grant | .5 | patent_licen[sc]e_to_make | grant_of_patent_licen[sc]e
freeware | .5 | freeware | shareware_licen[sc]e
"""


def literals(parsed) -> set[str]:
    """The runs of characters that every match contains; what is optional, a class or one of several ends a run."""
    out, run = set(), ""
    for op, x in [*parsed, (None, None)]:
        if op is _constants.LITERAL:
            run += chr(x)
            continue
        out, run = out | {run}, ""
        if op is _constants.SUBPATTERN:
            out |= literals(x[3])
        elif op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT) and x[0]:
            out |= literals(x[2])
    return out - {""}


@functools.lru_cache(maxsize=1)
def rules():
    """(automaton of literals, rules by their longest literal); a rule is (priority, label, confidence, regex, its other literals)."""
    by_keyword: dict[str, list] = {}
    words = {p.split()[-1] for p, _ in BASE}
    for priority, line in enumerate(x for x in RULES.strip().splitlines() if x.strip()):
        label, confidence, *patterns = (part.strip() for part in re.split(r" \| ", line))
        for p in patterns:
            compiled = re.compile(r"(?<![a-z0-9])(?:" + p.replace("_", r"(?:[\s,;:*#/-]+)") + ")", re.DOTALL)
            keyword, *others = sorted(literals(_parser.parse(compiled.pattern, re.DOTALL)), key=lambda x: (-len(x), x))
            others = frozenset(x for x in others if len(x) >= 3)
            words |= {keyword, *others}
            by_keyword.setdefault(keyword, []).append((priority, label, float(confidence), compiled, others))
    matcher = ahocorasick.Automaton()
    for k in sorted(words):
        matcher.add_word(k, k)
    matcher.make_automaton()
    return matcher, by_keyword


def settle(found: list[tuple[int, int, int, str, float]]) -> list[tuple[int, int, int, str, float]]:
    """Detections (start, end, priority, label, confidence) that stay.

    By priority: a detection goes if it overlaps a kept one of higher priority; of one rule's, those that lie inside
    another go, while those that overlap in part stay. Of equal ones one stays. Sorted once, so linear but for that.
    """
    kept: list[tuple[int, int, int, str, float]] = []
    starts: list[int] = []  # what is kept of higher priority, as intervals without overlap, in order
    ends: list[int] = []
    for _, group in itertools.groupby(sorted(found, key=lambda d: (d[2], d[0], -d[1], d[3])), key=lambda d: d[2]):
        far, own = -1, []
        for d in group:
            k = bisect.bisect_right(starts, d[0])
            if (k and ends[k - 1] > d[0]) or (k < len(starts) and starts[k] < d[1]) or d[1] <= far:
                continue
            far = d[1]
            own.append(d)
        kept += own
        spans_ = sorted([*zip(starts, ends, strict=True), *((d[0], d[1]) for d in own)])
        starts, ends = [], []
        for a, b in spans_:
            if ends and a < ends[-1]:
                ends[-1] = max(ends[-1], b)
            else:
                starts.append(a)
                ends.append(b)
    return sorted(kept)


BASE_HITS = [(re.compile(r"(?<![^\x00-\x2F\x3A-\x60\x7B-\x7F])" + GAP.join(p.split()) + r"(?![^\x00-\x2F\x3A-\x60\x7B-\x7F])"), label) for p, label in BASE]


def scan_text(text: str) -> dict:
    """Places and labels of one text, in words and code points."""
    low = text.encode().lower().decode()  # A-Z only
    matcher, by_keyword = rules()
    present = {k for _, k in matcher.iter(low)}
    out = {"n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0, "spans": []}
    if not present:
        return out
    places = []
    for pattern, label in BASE_HITS:
        places += [(m.start(), label) for m in pattern.finditer(low)]
    found = []
    for k in present & by_keyword.keys():
        for priority, label, confidence, pattern, others in by_keyword[k]:
            if others <= present:
                found += [(m.start(), m.end(), priority, label, confidence) for m in pattern.finditer(low) if m.end() > m.start()]
    kept = settle(found)
    if places:
        places.sort()
        starts = np.array([m.start() for m in WORDS.finditer(low)])
        at = np.searchsorted(starts, [p for p, _ in places])
        out |= {"n_base": len(places), "first_word": int(at.min()), "last_word": int(at.max()), "base_labels": ",".join(sorted({x for _, x in places}))}
    labels = {x for _, x in places} | {d[3] for d in kept}
    doubt = 1.0
    for c in {d[3]: d[4] for d in kept}.values():
        doubt *= 1.0 - c
    out |= {"labels": ",".join(sorted(labels)), "score": max(1.0 - doubt, 1.0 if places else 0.0), "spans": [f"{d[3]}:{d[0]}:{d[1]}" for d in kept]}
    return out


def _scan(text: str, keep: list[str]):
    names = ["n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string())]

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                data, off = text_buffer(part.column(text))
                start, _ = spans(WORD[LOWER[data]], off)
                n_words = np.diff(np.searchsorted(start, off))
                rows = [scan_text(t or "") for t in part.column(text).to_pylist()]
                columns = [pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(n_words), *columns], [*keep, "n_words", *names])

    return run


def scan_licenses(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_words, n_base, first_word, last_word, base_labels, labels, score and spans (label:start:end).

    Every whole text is scanned; a null or empty text has no words, no places, empty labels and score 0. score is the
    chance that any kept detection holds, 1 at base places. Rows are independent of each other and of other columns;
    keep must not name an added column. Detections are settled in the time it takes to sort them.
    """
    ship(docs.sparkSession)
    keep = list(keep)
    schema = with_fields(docs.select(*keep).schema, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<string>")
    return docs.select(*keep, text).mapInArrow(_scan(text, keep), schema)


def query(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
