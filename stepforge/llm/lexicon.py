"""Words of abuse, hate and sexual content in four languages, for use as a prior.

STRONG words hardly occur in harmless text, MILD ones often do; PAIRS are two words in a row.
"""

STRONG = frozenset(
    # English: insults
    "asshole assholes arsehole bastard bitch bitches bollocks bullshit cocksucker cretin cunt cunts dickhead dipshit douchebag dumbass "
    "dumbfuck faggot fag fucker fuckers fuck fucked fucking fuckwit halfwit idiot idiots imbecile imbeciles jackass jerkoff loser losers "
    "moron morons motherfucker nitwit piss prick pricks retard retarded scumbag scumbags scum shit shithead shitty shitface slut sluts "
    "tosser twat twats twit wanker wankers whore whores skank slag trollop nigger niggers nigga kike spic chink gook wetback tranny dyke "
    "subhuman subhumans vermin degenerate degenerates "
    # English: sexual
    "blowjob boobs boner clit cum cumshot cumming dildo ejaculate erection horny jizz masturbate masturbating masturbated nudes nude "
    "orgasm orgasms panties pussy porn porno pornographic sexting threesome tits titties vagina penis nipples jerked handjob moaned moaning "
    # German
    "arschloch arschlöcher arsch bastard depp drecksau dreckskerl fick ficken fotze gefickt hure hurensohn idiot idioten kanake "
    "missgeburt miststück mistkerl muschi nutte nutten penner scheiße scheisse schlampe schlampen schwuchtel spast spasti titten "
    "trottel vollidiot volltrottel vollpfosten wichser wichsen untermensch untermenschen abschaum ungeziefer fresse "
    # Spanish
    "cabrón cabrones capullo coño culo follar follando gilipollas hijoputa idiota idiotas imbécil imbéciles joder maricón maricones mierda "
    "pendejo pendejos polla puta putas puto putos tetas zorra zorras subnormal estúpido estúpida escoria malnacido desgraciado tarado "
    # French
    "abruti abrutis bâtard bite bordel branleur chatte connard connards connasse conne couilles crétin cul débile enculé enculés encule "
    "foutre merde nichons niquer nique pédé pute putes putain salaud salauds salope salopes seins ordure ordures enfoiré racaille vermine".split()
)

MILD = frozenset(
    "brainless disgusting filthy pathetic miserable worthless stupid dumb ugly garbage trash sick hate hates kill die dead hurt strangle "
    "choke rape raped stab murder slaughter exterminate gas lynch naked stripped moan sex sexy lick suck cock dick breasts bent "
    "thieves thief criminals parasites rats pigs pig animals savages cockroaches foreigners immigrants cripples lazy dishonest scream "
    "dumm dumme dummes dummer blöd blöde ekelhaft widerlich hässlich schwein schweine sau dreck drecks umbringen töte töten stirb "
    "verrecke verrecken hasse ratten diebe pack ausländer ausziehen nackt nackte sex geil "
    "asco asqueroso asquerosa inútil sucio sucia basura matar mataré muere muérete odio ratas cerdo cerdos ladrones parásitos desnuda "
    "desnudo desnúdate sexo largo fuera sale sales dégage tuer tuerai crève crever haine rats porc porcs voleurs parasites nue nu sexe "
    "déshabille dehors con stupide dégoûtant".split()
)

PAIRS = frozenset(
    (tuple(p.split("_")))
    for p in (
        "kill_yourself kill_you hurt_you hate_you fuck_you screw_you shut_up your_mouth your_face smash_your break_your you_pathetic "
        "you_filthy you_disgusting you_worthless you_stupid you_idiot you_lazy you_miserable are_vermin are_thieves are_rats are_animals "
        "too_stupid so_stupid are_stupid like_rats like_vermin breed_like are_dead you_live nobody_wants wants_you disappear_forever to_hell them_back they_came gone_for "
        "my_cock his_cock my_dick his_dick suck_my lick_my lick_your loud_sex stripped_naked brain_dead me_sick your_tits me_nudes "
        "du_wichser du_arschloch du_idiot dich_um bring_dich ich_hasse halt_die die_fresse zieh_dich dich_aus deine_titten raus_mit "
        "dummes_schwein sind_ratten sind_diebe sind_ungeziefer eres_un te_odio te_mataré te_voy hijo_de de_puta de_mierda son_ratas "
        "merecen_vivir nadie_te tus_tetas ferme_ta ta_gueule sale_con je_vais te_tuer va_te te_faire tes_seins sont_des sale_pute"
    ).split()
)

#: Letters that digits and signs stand for in disguised spelling; 1, ! and | may also be an l.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t", "|": "i", "€": "e"}

#: Look-alike letters of other scripts.
LOOKALIKES = str.maketrans("аеіорсухѕјһԁɡ", "aeiopcyxsjhdg")
