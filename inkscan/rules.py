"""What must equal published values for right results, as plain tables.

Thresholds, weights, word lists and patterns; nothing here is logic.
"""

from __future__ import annotations

# Fixed values: (id, category, kind, prior weight, metric, direction, ru lo, ru hi, en lo, en hi, ru corridor, en corridor).
DETECTORS = [
    ('T-01', 'typography', 'text', 1.5, 'mixed_words', 'up', 0.0, 2.0, 0.0, 2.0, (0.0, 0.0), (0.0, 0.0)),
    ('T-02', 'typography', 'text', 1.5, 'invisible_chars', 'up', 0.0, 3.0, 0.0, 3.0, (0.0, 0.0), (0.0, 0.0)),
    ('T-03', 'typography', 'text', 1.0, 'em_dash_per_1000', 'up', 6.0, 22.0, 1.0, 9.0, (0.0, 8.0), (0.0, 2.0)),
    ('T-04', 'typography', 'text', 0.2, 'mixed_styles', 'up', 0.0, 2.0, 0.0, 2.0, (0.0, 1.0), (0.0, 1.0)),
    ('T-05', 'typography', 'text', 1.0, 'markdown_marks', 'up', 0.0, 4.0, 0.0, 4.0, (0.0, 0.0), (0.0, 0.0)),
    ('T-06', 'typography', 'text', 0.3, 'yo_ratio', 'up', 0.5, 1.0, 0.0, 1.0, (0.0, 0.6), (0.0, 1.0)),
    ('R-01', 'style', 'text', 2.0, 'sentence_cv', 'down', 0.35, 0.6, 0.35, 0.6, (0.5, 0.9), (0.5, 0.9)),
    ('R-02', 'style', 'text', 1.2, 'extreme_share', 'down', 0.04, 0.2, 0.04, 0.2, (0.15, 0.45), (0.15, 0.45)),
    ('R-03', 'style', 'text', 1.0, 'paragraph_cv', 'down', 0.2, 0.5, 0.2, 0.5, (0.4, 1.0), (0.4, 1.0)),
    ('R-04', 'style', 'text', 0.5, 'rhythm_autocorr', 'up', 0.15, 0.6, 0.15, 0.6, (-0.3, 0.2), (-0.3, 0.2)),
    ('R-05', 'style', 'text', 0.6, 'start_repeat', 'up', 0.15, 0.4, 0.2, 0.45, (0.0, 0.15), (0.0, 0.2)),
    ('L-01', 'lexicon', 'text', 2.5, 'marker_density', 'up', 1.0, 12.0, 1.0, 12.0, (0.0, 2.0), (0.0, 2.0)),
    ('L-02', 'lexicon', 'text', 0.6, 'mattr_cv', 'down', 0.03, 0.08, 0.03, 0.08, (0.06, 0.15), (0.06, 0.15)),
    ('L-03', 'lexicon', 'text', 0.6, 'hapax_ratio', 'down', 0.6, 0.8, 0.5, 0.72, (0.72, 0.95), (0.62, 0.9)),
    ('L-04', 'lexicon', 'text', 1.0, 'hedge_density', 'up', 40.0, 110.0, 30.0, 90.0, (0.0, 50.0), (0.0, 40.0)),
    ('L-05', 'lexicon', 'text', 2.0, 'noise_density', 'down', 8.0, 40.0, 10.0, 50.0, (25.0, 120.0), (30.0, 140.0)),
    ('L-06', 'lexicon', 'text', 0.6, 'ngram_repeats', 'up', 2.0, 12.0, 3.0, 15.0, (0.0, 4.0), (0.0, 5.0)),
    ('S-01', 'structure', 'text', 1.2, 'template_score', 'up', 0.0, 1.0, 0.0, 1.0, (0.0, 0.3), (0.0, 0.3)),
    ('S-02', 'structure', 'text', 1.0, 'triads_per_1000', 'up', 2.0, 10.0, 2.0, 10.0, (0.0, 3.0), (0.0, 3.0)),
    ('S-03', 'structure', 'text', 0.6, 'template_headings', 'up', 0.0, 3.0, 0.0, 3.0, (0.0, 0.0), (0.0, 0.0)),
    ('S-04', 'structure', 'text', 0.7, 'uniform_list_share', 'up', 0.5, 1.0, 0.5, 1.0, (0.0, 0.5), (0.0, 0.5)),
    ('S-05', 'structure', 'text', 0.7, 'summary_endings', 'up', 0.1, 0.5, 0.1, 0.5, (0.0, 0.15), (0.0, 0.15)),
    ('S-06', 'structure', 'text', 0.8, 'contrast_per_1000', 'up', 1.0, 6.0, 0.5, 5.0, (0.0, 2.0), (0.0, 1.0)),
    ('S-07', 'structure', 'text', 1.5, 'assistant_flags', 'up', 0.5, 3.0, 0.5, 3.0, (0.0, 0.5), (0.0, 0.5)),
    ('S-08', 'structure', 'text', 1.6, 'section_flags', 'up', 0.5, 2.5, 0.5, 2.5, (0.0, 0.5), (0.0, 0.5)),
    ('B-01', 'structure', 'text', 2.2, 'citation_flags', 'up', 0.5, 2.5, 0.5, 2.5, (0.0, 0.5), (0.0, 0.5)),
    ('L-07', 'lexicon', 'text', 1.4, 'attribution_density', 'up', 4.0, 14.0, 4.0, 14.0, (0.0, 4.0), (0.0, 4.0)),
    ('P-01', 'stats', 'text', 1.0, 'perplexity_cv', 'down', 0.04, 0.1, 0.04, 0.1, (0.08, 0.2), (0.08, 0.2)),
    ('P-02', 'stats', 'text', 0.8, 'compression_ratio', 'down', 0.4, 0.48, 0.52, 0.6, (0.47, 0.6), (0.58, 0.7)),
    ('D-01', 'metadata', 'document', 2.0, 'meta_flags', 'up', 0.0, 2.0, 0.0, 2.0, (0.0, 0.0), (0.0, 0.0)),
    ('D-02', 'metadata', 'document', 1.5, 'words_per_minute', 'up', 60.0, 400.0, 60.0, 400.0, (0.0, 40.0), (0.0, 40.0)),
    ('D-03', 'metadata', 'document', 1.2, 'paste_flags', 'up', 0.0, 2.0, 0.0, 2.0, (0.0, 0.0), (0.0, 0.0)),
    ('D-04', 'metadata', 'document', 1.2, 'chat_format_flags', 'up', 0.0, 2.0, 0.0, 2.0, (0.0, 0.0), (0.0, 0.0)),
    ('D-05', 'metadata', 'document', 0.0, 'text_score', 'up', 0.0, 1.0, 0.0, 1.0, (0.0, 0.4), (0.0, 0.4)),
    ('I-01', 'image', 'image', 3.0, 'c2pa_ai', 'up', 0.0, 1.0, 0.0, 1.0, (0.0, 0.0), (0.0, 0.0)),
    ('I-02', 'image', 'image', 2.5, 'meta_flags', 'up', 0.0, 2.0, 0.0, 2.0, (0.0, 0.0), (0.0, 0.0)),
    ('I-03', 'image', 'image', 0.8, 'size_flags', 'up', 0.0, 2.0, 0.0, 2.0, (0.0, 0.0), (0.0, 0.0)),
    ('I-04', 'image', 'image', 0.6, 'spectral_peak', 'up', 4.0, 14.0, 4.0, 14.0, (0.0, 5.0), (0.0, 5.0)),
    ('I-05', 'image', 'image', 0.6, 'smooth_share', 'up', 0.3, 0.8, 0.3, 0.8, (0.0, 0.35), (0.0, 0.35)),
    ('I-06', 'image', 'image', 0.4, 'jpeg_flags', 'up', 0.0, 2.0, 0.0, 2.0, (0.0, 0.0), (0.0, 0.0)),
    ('I-07', 'image', 'image', 2.0, 'watermark_strength', 'up', 0.55, 0.85, 0.55, 0.85, (0.3, 0.5), (0.3, 0.5)),
    ('C-01', 'code', 'code', 1.5, 'comment_flags', 'up', 0.0, 3.0, 0.0, 3.0, (0.0, 1.0), (0.0, 1.0)),
    ('C-02', 'code', 'code', 0.8, 'dictionary_names', 'up', 0.3, 0.7, 0.3, 0.7, (0.1, 0.35), (0.1, 0.35)),
    ('C-03', 'code', 'code', 1.0, 'structure_flags', 'up', 0.0, 3.0, 0.0, 3.0, (0.0, 1.0), (0.0, 1.0)),
    ('C-04', 'code', 'code', 0.6, 'style_flags', 'up', 0.0, 2.0, 0.0, 2.0, (0.0, 1.0), (0.0, 1.0)),
    ('C-05', 'code', 'code', 2.5, 'chat_markers', 'up', 0.0, 2.0, 0.0, 2.0, (0.0, 0.0), (0.0, 0.0)),
]

# The calibrated model of texts.
TEXT_BIAS = -3.0924
TEXT_WEIGHTS = {'T-01': 0.0, 'T-02': 0.0, 'T-03': 1.3023, 'T-04': 0.4798, 'T-05': 0.9739, 'T-06': 0.529, 'R-01': 1.3174, 'R-02': 0.4644, 'R-03': 0.6396, 'R-04': 0.0, 'R-05': 0.0, 'L-01': 2.1414, 'L-02': 0.8018, 'L-03': 0.0, 'L-04': 0.7297, 'L-05': 1.3577, 'L-06': 0.0, 'S-01': 0.0, 'S-02': 0.5139, 'S-03': 0.0869, 'S-04': 0.3044, 'S-05': 0.0, 'S-06': 1.3343, 'S-07': 1.039, 'P-01': 0.0697, 'P-02': 0.0}

# The order of categories in reports.
CATEGORIES = ["style", "lexicon", "structure", "typography", "stats", "metadata", "image", "code"]

# Fixed values: (rule, detector, effort, expected gain, autofix).
ADVICE = [
    ('T-01.homoglyphs', 'T-01', 1, 10.0, True),
    ('T-02.invisible', 'T-02', 1, 10.0, True),
    ('T-03.perfect_typography', 'T-03', 1, 5.0, False),
    ('T-04.mixed_typography', 'T-04', 1, 1.0, False),
    ('T-05.markdown', 'T-05', 1, 6.0, False),
    ('T-06.yo', 'T-06', 1, 1.0, False),
    ('R-01.low_burstiness', 'R-01', 2, 8.0, False),
    ('R-02.no_extremes', 'R-02', 2, 5.0, False),
    ('R-03.uniform_paragraphs', 'R-03', 2, 4.0, False),
    ('R-04.rhythm', 'R-04', 2, 2.0, False),
    ('R-05.openings', 'R-05', 1, 3.0, False),
    ('L-01.markers', 'L-01', 1, 10.0, False),
    ('L-02.flat_diversity', 'L-02', 3, 2.0, False),
    ('L-03.thin_tail', 'L-03', 3, 2.0, False),
    ('L-04.hedging', 'L-04', 2, 4.0, False),
    ('L-05.no_noise', 'L-05', 2, 8.0, False),
    ('L-06.ngrams', 'L-06', 2, 3.0, False),
    ('S-01.template', 'S-01', 3, 6.0, False),
    ('S-02.triads', 'S-02', 1, 4.0, False),
    ('S-03.headings', 'S-03', 1, 3.0, False),
    ('S-04.uniform_lists', 'S-04', 2, 3.0, False),
    ('S-05.summary_endings', 'S-05', 2, 3.0, False),
    ('S-06.contrast', 'S-06', 1, 3.0, False),
    ('S-07.assistant_answer', 'S-07', 2, 8.0, False),
    ('B-01.citations', 'B-01', 2, 10.0, False),
    ('S-08.uniform_sections', 'S-08', 3, 6.0, False),
    ('L-07.attribution', 'L-07', 2, 5.0, False),
    ('P-01.low_perplexity', 'P-01', 3, 3.0, False),
    ('P-02.compressible', 'P-02', 3, 2.0, False),
    ('D-01.metadata', 'D-01', 1, 8.0, False),
    ('D-02.edit_time', 'D-02', 1, 5.0, False),
    ('D-03.paste', 'D-03', 2, 4.0, False),
    ('D-04.chat_format', 'D-04', 1, 4.0, False),
    ('I-01.c2pa', 'I-01', 1, 25.0, False),
    ('I-02.metadata', 'I-02', 1, 15.0, False),
    ('I-03.dimensions', 'I-03', 1, 3.0, False),
    ('I-04.spectrum', 'I-04', 3, 2.0, False),
    ('I-05.noise', 'I-05', 3, 2.0, False),
    ('I-06.jpeg', 'I-06', 3, 1.0, False),
    ('I-07.watermark', 'I-07', 3, 10.0, False),
    ('C-01.comments', 'C-01', 1, 6.0, False),
    ('C-02.naming', 'C-02', 2, 2.0, False),
    ('C-03.boilerplate', 'C-03', 2, 4.0, False),
    ('C-04.style', 'C-04', 3, 1.0, False),
    ('C-05.chat_markers', 'C-05', 1, 10.0, False),
]
# Fixed values: (rule, members, least number of them, effort).
COMBOS = [
    ('combo.too_even', ('R-01', 'R-03', 'S-01'), 2, 3),
    ('combo.chat_paste', ('T-05', 'S-03', 'S-04', 'D-04'), 2, 1),
]

# Fixed values: (pattern, weight, replacements) of marker phrases.
MARKERS = {
    'ru': [
        ('важно (?:отметить|подчеркнуть|понимать)', 2.0, ('удалить', 'кстати', 'заметьте')),
        ('стоит (?:отметить|подчеркнуть|упомянуть)', 2.0, ('удалить', 'кстати')),
        ('в заключение', 1.5, ('в итоге', 'короче говоря', 'удалить и закончить конкретным примером')),
        ('таким образом', 1.0, ('выходит', 'значит', 'удалить')),
        ('игра(?:ет|ют|л[аио]?) (?:ключев|важн|значительн)\\w* рол\\w*', 2.0, ('сильно влияет на', 'без него не работает')),
        ('в современном мире', 2.0, ('сейчас', 'сегодня', 'удалить')),
        ('явля(?:ется|ются) неотъемлемой частью', 2.0, ('входит в', 'без этого никак')),
        ('не только\\b[^.!?]{1,80}?\\bно и', 1.0, ('и … и …', 'разбить на два предложения')),
        ('давайте рассмотрим', 2.0, ('посмотрим', 'удалить')),
        ('погруз(?:имся|итесь|иться)', 2.0, ('разберёмся', 'посмотрим')),
        ('комплексн\\w* подход\\w*', 1.5, ('со всех сторон', 'по-разному')),
        ('широк\\w* спектр\\w*', 1.5, ('много', 'разные')),
        ('уникальн\\w*', 0.7, ('редкий', 'необычный', 'свой')),
        ('эффективн\\w*', 0.5, ('рабочий', 'толковый', 'быстрый')),
        ('оптимизир\\w*', 0.7, ('ускорить', 'упростить', 'подкрутить')),
        ('в целом', 0.7, ('в общем', 'удалить')),
        ('ключев\\w* (?:аспект|фактор|элемент)\\w*', 1.5, ('главное', 'основное')),
        ('позволя(?:ет|ют) (?:значительно|существенно)', 1.5, ('помогает', 'даёт')),
        ('(?:следует|необходимо) учитывать', 1.0, ('не забывайте', 'имейте в виду')),
        ('благодаря (?:этому|чему)', 0.7, ('поэтому', 'так что')),
        ('в эпоху (?:цифров|технолог)\\w*', 2.0, ('сейчас', 'удалить')),
        ('открыва(?:ет|ют) (?:новые )?(?:возможности|горизонты)', 1.5, ('даёт шанс', 'позволяет')),
    ],
    'en': [
        ('delv(?:e|es|ed|ing)', 3.0, ('look at', 'dig into', 'remove')),
        ('tapestry', 3.0, ('mix', 'set')),
        ('testament to', 2.5, ('shows', 'proves')),
        ('multifaceted', 2.0, ('complex', 'messy')),
        ('pivotal', 2.0, ('key', 'big')),
        ('crucial', 1.2, ('important', 'big', 'remove')),
        ('seamless(?:ly)?', 1.5, ('smooth', 'easy')),
        ('robust', 1.2, ('solid', 'sturdy')),
        ('leverag(?:e|es|ed|ing)', 1.5, ('use',)),
        ('foster(?:s|ed|ing)?', 1.5, ('build', 'grow', 'help')),
        ('navigat(?:e|ing) the (?:complexities|intricacies)', 3.0, ('deal with', 'handle')),
        ("in today'?s (?:fast-paced|digital|modern|ever-changing) world", 3.0, ('these days', 'now', 'remove')),
        ("it'?s (?:important|worth|crucial) (?:to note|noting|to remember)", 2.5, ('remove', 'by the way', 'note')),
        ('ever-(?:evolving|changing)', 2.0, ('changing', 'shifting')),
        ('realm', 2.0, ('area', 'field', 'world')),
        ('landscape', 1.2, ('scene', 'market', 'field')),
        ('underscor(?:e|es|ed|ing)', 2.0, ('show', 'stress')),
        ('intricate', 1.5, ('detailed', 'tricky')),
        ('in conclusion', 1.5, ('so', 'all in all', 'end with a concrete example')),
        ('furthermore', 1.0, ('also', 'plus')),
        ('moreover', 1.0, ('also', 'and')),
        ('embark(?:s|ed|ing)? on', 2.0, ('start', 'begin')),
        ('unlock(?:s|ing)? (?:the )?(?:full )?potential', 2.5, ('get more out of', 'make better use of')),
        ('a myriad of|myriad', 2.0, ('many', 'lots of')),
        ('plays? a (?:crucial|vital|key|pivotal|significant) role', 2.5, ('matters a lot for', 'drives')),
        ('harness(?:es|ed|ing)? the power', 2.5, ('use',)),
        ('comprehensive', 0.8, ('full', 'thorough')),
        ('vibrant', 1.2, ('lively', 'busy')),
    ],
}

# Word and phrase lists.
LEXICON = {
    'hedges': {
        'ru': ['может', 'могут', 'может быть', 'как правило', 'в некоторой степени', 'в определённой степени', 'в определенной степени', 'по всей видимости', 'вероятно', 'возможно', 'обычно', 'зачастую', 'в большинстве случаев', 'в целом', 'так или иначе', 'определённым образом', 'определенным образом', 'следует отметить', 'представляется', 'является', 'являются', 'осуществля', 'данный', 'данного', 'в рамках', 'с целью', 'в связи с', 'посредством'],
        'en': ['may', 'might', 'could', 'potentially', 'generally', 'typically', 'often', 'to some extent', 'in many cases', 'arguably', 'it seems', 'likely', 'perhaps', 'somewhat', 'relatively', 'in order to', 'utilize', 'utilise', 'facilitate', 'various', 'numerous', 'overall', 'ensure'],
    },
    'nominal_suffixes': {
        'ru': ['ание', 'ение', 'ость', 'ция', 'ирование', 'ании', 'ении', 'ости', 'ции'],
        'en': ['tion', 'ment', 'ness', 'ity', 'ance', 'ence'],
    },
    'noise': {
        'ru': ['ну', 'вот', 'же', 'ведь', 'типа', 'короче', 'блин', 'вообще', 'кстати', 'прям', 'реально', 'честно', 'наверное', 'фиг', 'ага', 'угу', 'ладно', 'нифига', 'капец', 'жесть', 'мол', 'дескать', 'я', 'мне', 'меня', 'мой', 'моя', 'моё', 'мои', 'мы', 'нам', 'нас', 'наш', 'наша', 'вчера', 'позавчера', 'сегодня', 'утром', 'вечером', 'ой', 'эх', 'хм', 'лол', 'чё', 'щас', 'тыщ', 'штук'],
        'en': ['i', "i'm", "i've", "i'd", 'me', 'my', 'we', 'our', 'us', 'yeah', 'nope', 'gonna', 'wanna', 'kinda', 'sorta', 'honestly', 'actually', 'basically', 'literally', 'lol', 'ok', 'okay', 'well', 'yesterday', 'tonight', 'stuff', 'guess', 'huh', 'damn', 'dunno', 'anyway', "can't", "don't", "didn't", "won't", "isn't", "wasn't", "it's", "that's", "there's", "you're", "we're", 'pretty'],
    },
    'conclusion': {
        'ru': ['в заключение', 'таким образом', 'подводя итог', 'в итоге', 'итак', 'заключение', 'вывод', 'выводы'],
        'en': ['in conclusion', 'to sum up', 'overall', 'ultimately', 'in summary', 'conclusion', 'final thoughts', 'to conclude'],
    },
    'summary_openers': {
        'ru': ['таким образом', 'в итоге', 'в целом', 'итак', 'подводя итог', 'следовательно', 'это означает', 'это делает'],
        'en': ['overall', 'ultimately', 'in short', 'in essence', 'thus', 'therefore', 'this means', 'this makes', 'in the end'],
    },
    'template_headings': {
        'ru': ['введение', 'заключение', 'преимущества', 'недостатки', 'плюсы и минусы', 'основные', 'ключевые', 'что такое', 'почему важно', 'итоги', 'вывод', 'выводы', 'советы', 'рекомендации', 'как выбрать'],
        'en': ['introduction', 'conclusion', 'benefits', 'advantages', 'disadvantages', 'pros and cons', 'key', 'what is', 'why it matters', 'final thoughts', 'takeaways', 'best practices', 'overview', 'how to choose'],
    },
    'assistant_openers': {
        'ru': ['коротко:', 'если коротко', 'короткий ответ', 'хороший вопрос', 'отличный вопрос', 'отличная идея', 'понимаю,', 'вот пошаговый', 'вот план', 'вот письмо', 'вот что', 'разберёмся', 'разберемся', 'расставил по порядку', 'расставила по порядку', 'от самого полезного', 'от простого к', 'для твоей ситуации', 'для вашей ситуации', 'в твоём случае', 'в вашем случае'],
        'en': ['short answer', 'great question', 'good question', 'good news', 'sorry to hear', "here's a", "here's what", "here's how", 'here are', "let's break", 'in your situation', 'from quickest to', 'from simplest to', 'in order of'],
    },
    'assistant_recaps': {
        'ru': ['итого:', 'итог:', 'минимум, если', 'главное —', 'главное:', 'что бы я выбрал', 'я бы выбрал', 'я бы начал', 'совет напоследок', 'и главное', 'и мысль', 'если коротко'],
        'en': ['bottom line', 'tl;dr', 'the short version', "i'd go with", "i'd start", "what i'd do", 'remember:', 'ultimately,', 'the key is', 'if you only'],
    },
    'assistant_offers': {
        'ru': ['помогу', 'подберу', 'подскажу', 'могу помочь', 'если хочешь', 'если хотите', 'напиши, ', 'покажи ', 'расскажи '],
        'en': ['i can help', 'i can suggest', 'want me to', 'let me know', 'if you share', 'tell me', "i'll suggest", 'happy to help'],
    },
    'academic_markers': {
        'ru': ['фундаментальн', 'принципиально ин', 'детально раскры', 'детально описа', 'на стыке', 'раскрывается механизм', 'раскрывает механизм', 'предельн', 'в фундаментальном исследовании', 'программн', 'онтологическ', 'кристаллизовал', 'глубоко укоренивш', 'лавинообразн', 'демонстрирует устойчивое', 'формулирует практический', 'возвращающий', 'нормативных правил', 'приводит к фундаментальному выводу', 'в противовес этому', 'эту же закономерность', 'эту закономерность'],
        'en': ['seminal', 'foundational', 'at the intersection of', 'sheds light on', 'shed light on', 'nuanced', 'underscores the', 'a lens through which', 'this paper argues', 'it is worth noting', 'plays a pivotal', 'in the context of', 'multifaceted', 'paradigm shift', 'lays the groundwork', 'a growing body of'],
    },
}

# What chats leave in code.
CHAT_MARKERS = ["here'?s (?:the|an?) (?:updated|complete|full|revised|improved|corrected|modified) (?:code|version|script|implementation)", 'example usage:?', 'your_api_key_here|your-api-key|<your[_ -]api[_ -]key>|YOUR_API_KEY', 'replace (?:this|with your) (?:own )?(?:api key|value|path)', 'certainly!|sure! here|i hope this helps|let me know if', 'this (?:code|script|function) (?:demonstrates|does the following|will)', 'вот (?:обновлённый|обновленный|исправленный|полный) код', 'пример использования:?']
